"""A small labelled table of URLs to start a filter with (invented; fixed values).

Hosts are under reserved names.  A user's own table of ``url, label`` rows
takes its place in ``urls.train``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BLOCK = """
https://www.lucky-casino.example.com/slots
http://online-casino-bonus.example.net/en/1
https://win-casino.example.org/free-spins
https://blog.poker-win.example.com/en/77
https://best-bets.example.net/odds/today
http://sports-bets-online.example.org/
https://free-betting.example.com/de/12
https://m.bets-now.example.net/live
https://jackpot-win.example.org/claim?id=2
https://free-jackpots.example.com/es/9
http://cheap-meds.example.net/buy-now
https://cheap-drugs-online.example.com/pills
https://www.pills-shop.example.org/fr/3
https://diet-pills.example.net/order.html
https://best-pills-online.example.com/cheap
http://cheap-watches.example.org/replica
https://cheap-loans-fast.example.net/apply
https://free-money-fast.example.com/en/5
https://adult-chat.example.com/enter
http://adult-videos.example.net/xxx/12
https://www.xxx-cams.example.org/live
https://m.adult-dating.example.net/join
https://sexy-x-videos.example.com/adult
https://hot-singles-x.example.org/meet
http://ads-server.example.com/click?id=7
https://track-ads.example.net/pixel.gif
https://ad-track.example.org/redirect
https://click-tracker.example.com/ads/9
https://popup-ads.example.net/banner
https://ads.click-farm.example.org/go
http://link-farm.example.com/en/400
https://spam-links.example.net/page/8
https://www.seo-spam.example.org/backlinks
https://article-farm.example.com/de/66
https://content-spam-farm.example.net/fr/1
https://like-farm.example.org/buy-followers
http://free-iphone-win.example.com/prize
https://win-prize-now.example.net/claim
https://crack-keygen.example.org/download
https://free-warez.example.com/serial
https://phish-login.example.net/verify-account
https://secure-bank-verify.example.org/login.php
""".split()

ALLOW = """
https://www.example.com/
http://news.example.org/2021/04/article.html
https://blog.garden.example.net/en/12
https://river.example.com/de/345
https://m.history.example.org/fr/88?page=2
https://www.library.example.net/catalogue/books
http://museum.example.com/en/9#top
https://docs.software.example.org/guide/install
https://forum.cooking.example.net/es/130/
https://science.example.com/papers/412.html
https://www.weather.example.org/city/berlin
https://school.example.net/de/77
http://www.theatre.example.com/programme
https://travel.example.org/fr/203?utm_source=feed
https://blog.mountain.example.net/en/671
https://maths.example.com/lessons/3
https://m.recipes.example.org/es/19
https://university.example.net/research/groups
http://www.another.example.com/en/825
https://theirs.example.org/de/7
https://blog.nation.example.net/fr/501#top
https://www.ringing.example.com/en/364/
https://thinking.example.org/es/18.html
http://harbour.example.net/ferries/timetable
https://orchestra.example.com/en/55
https://www.farmers-market.example.org/stalls
https://birds.example.net/species/heron
https://m.cycling.example.com/routes/12
https://painting.example.org/gallery/2
https://www.council.example.net/meetings/2019
http://health.example.com/advice/sleep
https://blog.thereafter.example.org/en/96
https://astronomy.example.net/es/707?page=2
https://www.chess.example.com/openings
https://trains.example.org/de/450
https://wiki.example.net/en/Main_Page
https://poetry.example.com/fr/31
https://www.hospital.example.org/visitors
http://gardening.example.net/roses.html
https://blog.ourhouse.example.com/en/240
https://language.example.org/es/866
https://archive.example.net/2003/11/
""".split()


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, "block") for u in BLOCK] + [(u, "allow") for u in ALLOW],
                                 "url string, label string")
