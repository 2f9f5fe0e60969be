"""Dataset path naming -- ``root/sub/`` + ``source + split + ext``."""

from __future__ import annotations

# Fixed names used by the reference's folder layout.
SPLITS = ("train", "dev", "test")
FORMATS = {"json": ".json", "tsv": ".tsv", "csv": ".csv", "parquet": ".parquet"}


def folder_path(root: str, sub: str) -> str:
    return f"{root.rstrip('/')}/{sub}"


def dataset_path(folder: str, source: str, split: str, fmt: str) -> str:
    """e.g. ``dataset_path("data/raw", "sts-", "dev", "tsv") -> data/raw/sts-dev.tsv``.

    Folders are not created here: Spark writers create them on write.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    return f"{folder.rstrip('/')}/{source}{split}{FORMATS[fmt]}"
