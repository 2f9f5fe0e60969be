"""DuckDB SQL twins of the catalog (the correctness oracle).

Written independently of the Spark code path: plain SQL with window
functions, list functions and self-joins, reading the same views
(``documents``, ``conversations``, ``embeddings``, ...).
"""

from __future__ import annotations

from ..operators.features import MAX_SEQ_LENGTH, N_SPECIAL
from . import catalog as Q
from . import standins as S

NL = "chr(10)"


def _u32(key_sql: str) -> str:
    return f"CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT)"


def _lines(table: str) -> str:
    return f"""lines AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (
    SELECT doc_id, unnest(arr) AS line, unnest(range(len(arr))) AS pos FROM (
      SELECT doc_id, string_split(replace(replace(text, '. ', '.' || {NL}), chr(160), ' '), {NL}) AS arr
      FROM {table})))"""


LINES = _lines("documents")
# Spelled out here on purpose: the oracle shares no class with the library.
MIN_SENTENCE_CHARS = 10
_SPACE = r"[\x{9}\x{A}\x{B}\x{C}\x{D}\x{1C}\x{1D}\x{1E}\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = f"'^{_SPACE}+|{_SPACE}+$'"
KEEP = (r"'[^\x{20}\x{22}\x{25}\x{27}-\x{B7}\x{2018}\x{2019}\x{201C}\x{201D}\x{3008}\x{3009}\x{300A}\x{300B}"
        r"\x{4E00}-\x{9FA5}\x{AC00}-\x{D7A3}]'")
# documents, and per benchmark item a null, a no-break-space, a CJK and a Hangul text
EDGE = """edge AS (
  SELECT doc_id, text FROM documents
  UNION ALL SELECT -4 * item_id - 1, NULL FROM benchmark
  UNION ALL SELECT -4 * item_id - 2, chr(160) || replace(text, ' ', chr(160)) FROM benchmark
  UNION ALL SELECT -4 * item_id - 3, chr(12288) || text || ' 漢字! #é€«龥龦» ' || chr(8195) || chr(133) FROM benchmark
  UNION ALL SELECT -4 * item_id - 4, '가나다. ' || text || '. 힣힤·한국어' || chr(160) FROM benchmark)"""
EDGE_LINES = f"{EDGE},\n{_lines('edge')}"
WIKI = f"""{LINES},
stripped AS (SELECT doc_id, pos, regexp_replace(line, {STRIP}, '', 'g') AS line FROM lines),
wiki AS (SELECT doc_id, pos, regexp_replace(line, {KEEP}, '', 'g') AS sentence
         FROM stripped WHERE length(line) >= {MIN_SENTENCE_CHARS})"""
PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS sentence1, b.text AS sentence2,
         CASE WHEN a.turn % 7 = 0 THEN NULL ELSE CAST((a.conv_id + a.turn) % 6 AS DOUBLE) END AS score
  FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn - 1 = a.turn)"""
HEADLINES = """headlines AS (
  SELECT item_id, text AS title, CAST(item_id % 7 AS INTEGER) AS label,
         CASE WHEN item_id % 2 = 0 THEN 'train' ELSE 'dev' END AS split FROM benchmark)"""
K = Q.VOCAB_SIZE - N_SPECIAL
VOCAB = f"""toks AS (SELECT unnest(list_filter(string_split(sentence, ' '), lambda t: t <> '')) AS token FROM wiki),
counts AS (SELECT token, count(*) AS cnt FROM toks GROUP BY token),
vocab AS (SELECT token, CAST(rn + {N_SPECIAL - 1} AS INTEGER) AS id, cnt FROM (
  SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rn FROM counts) WHERE rn <= {K})"""
GOLD = "CASE WHEN {a} = {b} THEN 5.0 ELSE 5.0 * (1.0 - abs({a} - {b}) / 9.0) END"
SCORED = f"""scored AS (
  SELECT CASE WHEN x.pair_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, x.pair_id, x.v1, y.v2,
         {GOLD.format(a='x.l1', b='y.l2')} AS gold
  FROM (SELECT vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS v1, label AS l1 FROM embeddings WHERE vec_id % 2 = 0) x
  LEFT JOIN (SELECT vec_id // 2 AS pair_id, CAST(embedding AS DOUBLE[]) AS v2, label AS l2 FROM embeddings WHERE vec_id % 2 = 1) y
  USING (pair_id))"""


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def _norm(a: str) -> str:
    return f"sqrt({_dot(a, a)})"


def _paired_cos(a: str, b: str) -> str:
    na, nb = _norm(a), _norm(b)
    ua = f"(CASE WHEN {na} > 0 THEN {a}[i] / {na} ELSE 0.0 END)"
    ub = f"(CASE WHEN {nb} > 0 THEN {b}[i] / {nb} ELSE 0.0 END)"
    return f"(1.0 - 0.5 * list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({ua} - {ub}) * ({ua} - {ub}))))"


def _manhattan(a, b):
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i])))"


def _euclid(a, b):
    return f"sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"


def _cos_temp(a, b, temp=0.05):
    return f"({_dot(a, b)} / greatest({_norm(a)} * {_norm(b)}, 1e-8) / {temp})"


def _ids_text(x: str) -> str:
    return f"array_to_string({x}, ',')"


def _encode(src: str, keys: list[str], text: str, name: str, pad: bool = True) -> str:
    """CTE ``name(keys..., ids)``: CLS + first L-2 token ids + SEP (+ PAD)."""
    k = ", ".join(keys)
    kq = ", ".join(f"s.{c}" for c in keys)
    L = MAX_SEQ_LENGTH
    body = f"list_concat([2], coalesce(t.ids, []), [3])"
    if pad:
        body = f"list_resize({body}, {L}, 0)"
    return f"""{name}_tok AS (
  SELECT {k}, unnest(tl) AS token, unnest(range(len(tl))) AS tpos FROM (
    SELECT {k}, list_slice(list_filter(string_split({text}, ' '), lambda t: t <> ''), 1, {L - 2}) AS tl FROM {src})),
{name}_ids AS (
  SELECT {k}, list(coalesce(v.id, 1) ORDER BY tpos) AS ids FROM {name}_tok LEFT JOIN vocab v USING (token) GROUP BY {k}),
{name} AS (
  SELECT {kq}, CAST({body} AS INTEGER[]) AS ids FROM {src} s LEFT JOIN {name}_ids t USING ({k}))"""


def _views(n: int, per: int, name: str) -> str:
    parts = []
    for k in range(n):
        parts.append(f"(SELECT vec_id // {n} AS rk, CAST(embedding AS DOUBLE[]) AS z, label AS l "
                     f"FROM embeddings WHERE vec_id % {n} = {k}) v{k}")
    joins = parts[0] + "".join(f" LEFT JOIN {p} USING (rk)" for p in parts[1:])
    zs = ", ".join(f"v{k}.z AS z{k + 1}" for k in range(n))
    return f"""{name} AS (
  SELECT rk // {per} AS batch_id, rk % {per} AS row, rk AS row_key, {zs}, {GOLD.format(a='v0.l', b='v1.l')} AS gold
  FROM {joins})"""


def _logits(view: str, n: int, weight: float = 0.0, temp: float = 0.05) -> str:
    sel = [f"SELECT a.batch_id, a.row, b.row AS j, {_cos_temp('a.z1', 'b.z2', temp)} AS logit, 0 AS kind "
           f"FROM {view} a JOIN {view} b USING (batch_id) WHERE b.z2 IS NOT NULL"]
    if n == 3:
        w = f" + CASE WHEN a.row = b.row THEN {weight} ELSE 0.0 END" if weight else ""
        sel.append(f"SELECT a.batch_id, a.row, b.row AS j, {_cos_temp('a.z1', 'b.z3', temp)}{w} AS logit, 1 AS kind "
                   f"FROM {view} a JOIN {view} b USING (batch_id) WHERE b.z3 IS NOT NULL")
    return f"""logits AS ({' UNION ALL '.join(sel)}),
lsum AS (
  SELECT batch_id, row, count(*) AS n_cols, max(logit) FILTER (WHERE kind = 0 AND j = row) AS pos_logit,
         max(logit) AS max_logit, max(logit) + ln(sum(exp(logit - mx))) AS lse
  FROM (SELECT *, max(logit) OVER (PARTITION BY batch_id, row) AS mx FROM logits)
  GROUP BY batch_id, row)"""


def _pearson(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _avg_rank(v: str, part: str) -> str:
    p = f"PARTITION BY {part}, " if part else "PARTITION BY "
    o = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({o}ORDER BY {v}) + (count(*) OVER ({p}{v}) - 1) / 2.0)"


def _eval(group: str | None) -> str:
    """Eight-metric report (per group)."""
    g = f"{group}, " if group else ""
    metrics = {
        "cosine": _paired_cos("v1", "v2"),
        "euclidean": f"-{_euclid('v1', 'v2')}",
        "manhattan": f"-{_manhattan('v1', 'v2')}",
        "dot": _dot("v1", "v2"),
    }
    scores = ", ".join(f"{e} AS {m}" for m, e in metrics.items())
    ranks = ", ".join(f"{_avg_rank(m, group or '')} AS r_{m}" for m in metrics) + \
        f", {_avg_rank('gold', group or '')} AS r_gold"
    aggs = []
    for m in metrics:
        aggs.append(f"round({_pearson(m, 'gold')}, 6) AS eval_{m}_pearson")
        aggs.append(f"round({_pearson('r_' + m, 'r_gold')}, 6) AS eval_{m}_spearman")
    grp = f" GROUP BY {group}" if group else ""
    return f"""WITH {SCORED},
s AS (SELECT {g}pair_id, gold, {scores} FROM scored),
r AS (SELECT *, {ranks} FROM s)
SELECT {g}{', '.join(aggs)} FROM r{grp}"""


METRICS = """metrics AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS metric
  FROM events)"""
BEST = """best AS (
  SELECT run, first(step ORDER BY metric DESC, step ASC) AS best_step, max(metric) AS best_metric
  FROM metrics WHERE metric IS NOT NULL GROUP BY run)"""


def _tsv_cols(alias_split: str | None = None) -> str:
    def clean(c):
        return f"nullif(regexp_replace(coalesce({c}, ''), '[\\t\\n\\r]', ' ', 'g'), '')"
    sp = f"{alias_split}, " if alias_split else ""
    return f"{sp}{clean('sentence1')} AS sentence1, {clean('sentence2')} AS sentence2, score"


def _mlm_sql() -> str:
    L = MAX_SEQ_LENGTH
    base = f"'{Q.SEED}:' || doc_id || ':' || pos"

    def u(view, draw):
        # draw d = hex digits 8(d-1)+1 .. 8d of one md5 per token
        h = f"md5({base} || ':{view}:' || (i - 1))"
        return f"(CAST(('0x' || substr({h}, {8 * (draw - 1) + 1}, 8)) AS BIGINT) / 4294967296.0)"

    parts = []
    for view in (0, 1):
        picked = f"(NOT list_contains([0, 1, 2, 3, 4], ids[i]) AND {u(view, 1)} < 0.15)"
        masked = f"({picked} AND {u(view, 2)} < 0.8)"
        rand = f"({picked} AND NOT {masked} AND {u(view, 3)} < 0.5)"
        rid = f"CAST(floor({u(view, 4)} * {Q.VOCAB_SIZE}) AS INTEGER)"
        new = f"CASE WHEN {masked} THEN 4 WHEN {rand} THEN {rid} ELSE ids[i] END"
        lab = f"CASE WHEN {picked} THEN ids[i] ELSE -100 END"
        parts.append(f"""SELECT doc_id, pos, {view} AS view,
  array_to_string(list_transform(range(1, {L} + 1), lambda i: {new}), ',') AS mlm_input_ids,
  array_to_string(list_transform(range(1, {L} + 1), lambda i: {lab}), ',') AS mlm_labels FROM enc""")
    return f"WITH {WIKI},\n{VOCAB},\n{_encode('wiki', ['doc_id', 'pos'], 'sentence', 'enc')}\n" + \
        "\nUNION ALL\n".join(parts)


def _eval_features_sql() -> str:
    return f"""{PAIRS},
pf AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
              coalesce(score, 0.0) / 5.0 AS labels, coalesce(sentence1, ' ') AS s1, coalesce(sentence2, ' ') AS s2
       FROM pairs),
{_encode('pf', ['conv_id', 'turn'], 's1', 'e1')},
{_encode('pf', ['conv_id', 'turn'], 's2', 'e2')},
ef AS (SELECT pf.conv_id, pf.turn, pf.split, pf.labels, e1.ids AS ids1, e2.ids AS ids2
       FROM pf JOIN e1 USING (conv_id, turn) JOIN e2 USING (conv_id, turn))"""


def _pool_sql(layers: tuple[int, ...]) -> str:
    n = len(layers)
    lay = ", ".join(str(x) for x in layers)
    return f"""WITH hidden AS (
  SELECT vec_id // 10 AS id, vec_id % 10 AS pos, CAST((vec_id % 10) < 3 + (vec_id // 10) % 7 AS INTEGER) AS mask,
         unnest(range(3)) AS layer,
         unnest([list_reverse(CAST(embedding AS DOUBLE[])), list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0.5),
                 CAST(embedding AS DOUBLE[])]) AS vec
  FROM embeddings),
h AS (SELECT id, layer, pos, mask, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM hidden)
SELECT id, CAST(dim AS INTEGER) AS dim,
       round(sum(v * mask) / {n}.0 / (sum(mask) FILTER (WHERE layer = {layers[-1]})), 6) AS value
FROM h WHERE layer IN ({lay}) GROUP BY id, dim"""


def oracle_sql() -> dict[str, str]:
    wiki = f"WITH {WIKI}\n"
    sql: dict[str, str] = {}
    sql["clean_sentences"] = wiki + "SELECT doc_id, pos, sentence FROM wiki"
    sql["sentence_break"] = f"SELECT doc_id, replace(text, '. ', '.' || {NL}) AS text FROM documents"
    sql["nbsp_norm"] = f"WITH {EDGE}\nSELECT doc_id, replace(replace(text, '. ', '.' || {NL}), chr(160), ' ') AS text FROM edge"
    sql["explode_sentences"] = f"WITH {LINES}\nSELECT doc_id, pos, line FROM lines"
    sql["strip_ws"] = f"WITH {EDGE_LINES}\nSELECT doc_id, pos, regexp_replace(line, {STRIP}, '', 'g') AS line FROM lines"
    sql["min_len"] = (f"WITH {EDGE_LINES},\nstripped AS (SELECT doc_id, pos, regexp_replace(line, {STRIP}, '', 'g') AS line FROM lines)\n"
                      f"SELECT doc_id, pos, line FROM stripped WHERE length(line) >= {MIN_SENTENCE_CHARS}")
    sql["char_filter"] = (f"WITH {EDGE_LINES}\nSELECT doc_id, pos, regexp_replace(regexp_replace(line, {STRIP}, '', 'g'), "
                          f"{KEEP}, '', 'g') AS line FROM lines")
    sql["drop_null"] = (f"WITH {PAIRS}\nSELECT * FROM pairs WHERE conv_id IS NOT NULL AND turn IS NOT NULL "
                        "AND sentence1 IS NOT NULL AND sentence2 IS NOT NULL AND score IS NOT NULL")
    sql["fill_null_text"] = (f"WITH {PAIRS}\nSELECT conv_id, turn, coalesce(sentence1, ' ') AS sentence1, "
                             "coalesce(sentence2, ' ') AS sentence2 FROM pairs")
    sql["norm_score"] = f"WITH {PAIRS}\nSELECT conv_id, turn, coalesce(score, 0.0) / 5.0 AS labels FROM pairs"
    sql["label_name"] = "SELECT doc_id, toxic AS labels FROM labels"
    sql["preview"] = wiki + "SELECT doc_id, pos, sentence FROM wiki ORDER BY doc_id, pos LIMIT 5"
    sql["rename_col"] = f"WITH {HEADLINES}\nSELECT item_id, label, title AS sentence FROM headlines"
    sql["drop_cols"] = f"WITH {PAIRS}\nSELECT conv_id, turn, coalesce(score, 0.0) / 5.0 AS labels FROM pairs"
    sql["project_col"] = wiki + "SELECT sentence FROM wiki"

    corpora = (f"WITH {WIKI},\n{HEADLINES},\ncorpora AS (\n"
               "  SELECT 0 AS src_ord, doc_id AS src_key, pos, sentence FROM wiki\n"
               "  UNION ALL SELECT 1, item_id, 0, title FROM headlines WHERE split = 'train'\n"
               "  UNION ALL SELECT 2, item_id, 0, title FROM headlines WHERE split = 'dev')\n")
    sql["union_corpora"] = corpora + "SELECT src_ord, src_key, pos, sentence FROM corpora"
    sql["unpivot_pairs"] = (f"WITH {PAIRS}\nSELECT conv_id, turn, 'sentence1' AS side, sentence1 AS sentence FROM pairs\n"
                            "UNION ALL SELECT conv_id, turn, 'sentence2', sentence2 FROM pairs")
    sql["union_pairs"] = (f"WITH {PAIRS},\n{HEADLINES}\nSELECT 0 AS src_ord, sentence1, sentence2 FROM pairs\n"
                          "UNION ALL SELECT 1, a.title, b.title FROM headlines a LEFT JOIN headlines b "
                          "ON b.item_id - 1 = a.item_id")
    prof = []
    for c in ("conv_id", "turn", "sentence1", "sentence2", "score"):
        prof.append(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM pairs")
    sql["profile"] = f"WITH {PAIRS}\n" + "\nUNION ALL ".join(prof)

    sql["src_corpus"] = "SELECT text FROM documents"
    sql["src_json"] = f"WITH {HEADLINES}\nSELECT title, label FROM headlines"
    sql["src_tsv"] = f"WITH {PAIRS}\nSELECT {_tsv_cols()} FROM pairs"
    sql["src_by_ext"] = wiki + "SELECT sentence FROM wiki"
    sql["src_splits"] = (f"WITH {PAIRS}\nSELECT {_tsv_cols()}, CASE WHEN conv_id % 2 = 0 THEN 'dev' ELSE 'test' END "
                         "AS split FROM pairs")
    sql["sink_csv"] = corpora + ("SELECT sentence FROM corpora UNION ALL "
                                 "SELECT CAST(NULL AS VARCHAR) FROM benchmark WHERE item_id % 5 = 0")
    ef = f"WITH {WIKI},\n{VOCAB},\n{_eval_features_sql()}\n"
    sql["sink_parquet"] = ef + ("SELECT split, conv_id, turn, round(labels, 6) AS labels, "
                                f"{_ids_text('ids1')} AS ids1, {_ids_text('ids2')} AS ids2 FROM ef")
    sql["src_split_pick"] = ef + "SELECT conv_id, turn, round(labels, 6) AS labels FROM ef WHERE split = 'dev'"

    blank = "coalesce(nullif(sentence, ''), ' ')"
    sql["self_pair"] = wiki + f"SELECT doc_id, pos, {blank} AS view0, {blank} AS view1 FROM wiki"
    sql["pair_build"] = (f"WITH {PAIRS}\nSELECT conv_id, turn, coalesce(sentence1, ' ') AS view0, "
                         "coalesce(sentence2, ' ') AS view1 FROM pairs")
    sql["build_vocab"] = f"WITH {WIKI},\n{VOCAB}\nSELECT token, id, cnt FROM vocab"
    enc = f"WITH {WIKI},\n{VOCAB},\n{_encode('wiki', ['doc_id', 'pos'], 'sentence', 'enc')}\n"
    sql["encode_pad"] = enc + f"SELECT doc_id, pos, {_ids_text('ids')} AS input_ids FROM enc"
    sql["attn_mask"] = enc + (f"SELECT doc_id, pos, {_ids_text('list_transform(ids, lambda x: CAST(x <> 0 AS INTEGER))')} "
                              f"AS attention_mask, {_ids_text('list_transform(ids, lambda x: 0)')} AS token_type_ids FROM enc")
    order = f"md5('{Q.SEED}:' || doc_id || ':' || pos), doc_id, pos"
    sql["batch_assign"] = (wiki + f"SELECT doc_id, pos, idx, idx // {Q.BATCH_SIZE} AS batch_id FROM ("
                           f"SELECT doc_id, pos, row_number() OVER (ORDER BY {order}) - 1 AS idx FROM wiki)")
    enc_np = f"WITH {WIKI},\n{VOCAB},\n{_encode('wiki', ['doc_id', 'pos'], 'sentence', 'enc', pad=False)},\n"
    sql["pad_batch"] = enc_np + (
        f"b AS (SELECT doc_id, pos, ids, (row_number() OVER (ORDER BY {order}) - 1) // {Q.BATCH_SIZE} AS batch_id FROM enc),\n"
        f"w AS (SELECT *, CAST(ceil(max(len(ids)) OVER (PARTITION BY batch_id) / {Q.PAD_MULTIPLE}.0) * {Q.PAD_MULTIPLE} AS INTEGER) AS width FROM b)\n"
        f"SELECT doc_id, pos, batch_id, width, {_ids_text('list_resize(ids, width, 0)')} AS input_ids FROM w")
    sql["flatten_views"] = enc + (
        f"SELECT doc_id, pos, v AS view, {_ids_text('ids')} AS input_ids, "
        f"{_ids_text('list_transform(ids, lambda x: CAST(x <> 0 AS INTEGER))')} AS attention_mask "
        "FROM enc, (SELECT 0 AS v UNION ALL SELECT 1) vv")
    sql["restore_views"] = ef + f"SELECT conv_id, turn, {_ids_text('ids1')} AS ids1, {_ids_text('ids2')} AS ids2 FROM ef"
    sql["collate_hook"] = ef + (
        f"SELECT conv_id, turn, used, idx, idx // {Q.BATCH_SIZE} AS batch_id FROM ("
        "SELECT conv_id, turn, used, row_number() OVER (ORDER BY used, conv_id, turn) - 1 AS idx FROM ("
        "SELECT conv_id, turn, CAST(len(list_filter(ids1, lambda x: x <> 0)) AS INTEGER) AS used FROM ef))")
    sql["take_view"] = ef + f"SELECT conv_id, turn, {_ids_text('ids2')} AS input_ids FROM ef"
    sql["dedup_label"] = ef + "SELECT conv_id, turn, round(labels, 6) AS labels FROM ef"
    sql["mlm_mask"] = _mlm_sql()
    sql["map_batches"] = wiki + ("SELECT doc_id, pos, CAST(length(sentence) AS BIGINT) AS n_chars, "
                                 "CAST(least(length(sentence), 64) AS BIGINT) AS n_chars_capped, "
                                 "CAST(len(string_split(sentence, ' ')) AS BIGINT) AS n_pieces FROM wiki")
    sql["map_files"] = sql["map_batches"]
    sql["holdout_split"] = wiki + (f"SELECT doc_id, pos, CASE WHEN {_u32(chr(39) + str(Q.SEED) + ':' + chr(39) + ' || doc_id || ' + chr(39) + ':' + chr(39) + ' || pos')} % 100 < 5 "
                                   "THEN 'validation' ELSE 'train' END AS split FROM wiki")

    sql["pool_cls"] = ("SELECT vec_id // 10 AS id, CAST(d AS INTEGER) AS dim, round(v, 6) AS value FROM ("
                       "SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS d "
                       "FROM embeddings WHERE vec_id % 10 = 0)")
    sql["pool_avg"] = _pool_sql((2,))
    sql["pool_first_last"] = _pool_sql((0, 2))
    sql["pool_top2"] = _pool_sql((1, 2))
    sql["dense_tanh"] = (f"SELECT vec_id, CAST(o AS INTEGER) AS dim, round(tanh(sum(v * sin(o * 64 + i) / 8.0)), 6) AS value "
                         "FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i "
                         f"FROM embeddings) e, range({Q.DENSE_OUT}) r(o) GROUP BY vec_id, o")
    sql["cos_temp"] = f"WITH {SCORED}\nSELECT pair_id, round({_cos_temp('v1', 'v2')}, 6) AS logit FROM scored"
    sql["sim_cosine"] = f"WITH {SCORED}\nSELECT split, pair_id, round({_paired_cos('v1', 'v2')}, 6) AS score FROM scored"
    sql["sim_manhattan"] = f"WITH {SCORED}\nSELECT split, pair_id, round(-{_manhattan('v1', 'v2')}, 6) AS score FROM scored"
    sql["sim_euclidean"] = f"WITH {SCORED}\nSELECT split, pair_id, round(-{_euclid('v1', 'v2')}, 6) AS score FROM scored"
    sql["sim_dot"] = f"WITH {SCORED}\nSELECT split, pair_id, round({_dot('v1', 'v2')}, 6) AS score FROM scored"

    summary = ("SELECT batch_id, row, CAST(n_cols AS INTEGER) AS n_cols, round(pos_logit, 6) AS pos_logit, "
               "round(max_logit, 6) AS max_logit, round(lse, 6) AS lse FROM lsum")
    v2 = _views(2, S.PAIR_BATCH_ROWS, "v2")
    v3 = _views(3, S.TRIPLE_BATCH_ROWS, "v3")
    sql["batch_sim"] = f"WITH {v2},\n{_logits('v2', 2)}\n{summary}"
    sql["hard_neg_cols"] = f"WITH {v3},\n{_logits('v3', 3)}\n{summary}"
    sql["hard_neg_weight"] = f"WITH {v3},\n{_logits('v3', 3, weight=1.0)}\n{summary}"
    sql["info_nce"] = (f"WITH {v2},\n{_logits('v2', 2)}\nSELECT batch_id, count(*) AS n_rows, "
                       "round(avg(lse - pos_logit), 6) AS loss FROM lsum GROUP BY batch_id")
    g = S.GLOBAL_RANKS * S.LOCAL_BATCH_ROWS
    sql["global_batch"] = (f"WITH {_views(2, g, 'vg')},\n{_logits('vg', 2)}\nSELECT batch_id AS step, count(*) AS n_rows, "
                           "round(avg(lse - pos_logit), 6) AS loss FROM lsum GROUP BY batch_id")
    mlm_lab = f"CASE WHEN u % 100 < {100 - S.MLM_LABELLED_PERCENT} THEN -100 ELSE CAST(u % {S.MLM_VOCAB} AS INTEGER) END"
    sql["masked_ce"] = f"""WITH ev AS (SELECT event_id // 10 AS row, event_id % 10 AS pos, value,
                  {_u32("'mlm:' || event_id")} AS u FROM events),
lg AS (SELECT row, pos, {mlm_lab} AS label, v AS vocab_id, 3.0 * sin(value + v) AS logit FROM ev, range({S.MLM_VOCAB}) t(v)),
tok AS (SELECT row, pos, mx + ln(sum(exp(logit - mx))) - sum(CASE WHEN vocab_id = label THEN logit END) AS tl
        FROM (SELECT *, max(logit) OVER (PARTITION BY row, pos) AS mx FROM lg WHERE label <> -100)
        GROUP BY row, pos, mx)
SELECT count(*) AS n_tokens, round(avg(tl), 6) AS mlm_loss, round(0.1 * avg(tl), 6) AS weighted_mlm_loss FROM tok"""
    sql["diag_scores"] = (f"WITH {v2}\nSELECT batch_id, row, round({_cos_temp('z1', 'z2', 1.0)}, 6) AS score FROM v2")

    sql["pearson"] = (f"WITH {SCORED},\ns AS (SELECT split, gold, {_paired_cos('v1', 'v2')} AS x FROM scored)\n"
                      f"SELECT split, round({_pearson('x', 'gold')}, 6) AS pearson FROM s GROUP BY split")
    sql["spearman"] = (f"WITH {SCORED},\ns AS (SELECT split, gold, {_paired_cos('v1', 'v2')} AS x FROM scored),\n"
                       f"r AS (SELECT split, {_avg_rank('x', 'split')} AS rx, {_avg_rank('gold', 'split')} AS ry FROM s)\n"
                       f"SELECT split, round({_pearson('rx', 'ry')}, 6) AS spearman FROM r GROUP BY split")
    sql["eval_report"] = _eval(None)
    sql["eval_by_split"] = _eval("split")
    sql["metric_hook"] = (f"WITH {SCORED},\ns AS (SELECT split, abs({_paired_cos('v1', 'v2')} - gold / 5.0) AS off FROM scored)\n"
                          "SELECT split, count(off) AS n, round(avg(off), 6) AS mean_off FROM s GROUP BY split")
    sql["eval_diag_report"] = (f"WITH {v2},\nd AS (SELECT gold, {_cos_temp('z1', 'z2', 1.0)} AS x FROM v2),\n"
                               f"r AS (SELECT x, gold, {_avg_rank('x', '')} AS rx, {_avg_rank('gold', '')} AS ry FROM d)\n"
                               f"SELECT round({_pearson('x', 'gold')}, 6) AS pearson, "
                               f"round({_pearson('rx', 'ry')}, 6) AS spearman FROM r")

    sql["best_checkpoint"] = f"WITH {METRICS},\n{BEST}\nSELECT run, best_step, round(best_metric, 6) AS best_metric FROM best"
    sql["early_stop"] = f"""WITH {METRICS},
m1 AS (SELECT *, max(metric) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best,
              max(metric) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_so_far FROM metrics),
m2 AS (SELECT *, max(CASE WHEN metric IS NOT NULL AND (prev_best IS NULL OR metric > prev_best) THEN step END)
              OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS last_improved FROM m1)
SELECT run, min(step) FILTER (WHERE step - last_improved >= 3) AS stop_step,
       coalesce(arg_min(last_improved, step) FILTER (WHERE step - last_improved >= 3), arg_max(last_improved, step)) AS best_step,
       round(coalesce(arg_min(best_so_far, step) FILTER (WHERE step - last_improved >= 3), arg_max(best_so_far, step)), 6) AS best_metric
FROM m2 GROUP BY run"""
    sql["retain_last_k"] = f"""WITH {METRICS},
{BEST},
m AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) - 1 AS newest FROM metrics)
SELECT m.run, m.step, round(m.metric, 6) AS metric, (m.step = b.best_step) AS is_best
FROM m LEFT JOIN best b USING (run) WHERE newest < 6 OR m.step = b.best_step"""
    return sql
