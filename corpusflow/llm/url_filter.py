"""URL filters: rules first, then logistic regression on hashed character n-grams.

Host and path of a URL are cut into n-grams of 3 to 5 bytes and hashed into
buckets, apart for host and path. A logistic regression is fitted on the driver
from a small labelled table and judges the URLs that no rule fits.

Defined cases: a null URL or one without ``://`` has an empty host and path, and
the method judges it like any other; the method's bias alone judges URLs without
an n-gram; repeated rows are judged each; an empty table gives no rows; other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import utf8

BUCKETS = 1 << 12
ORDERS = (3, 4, 5)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Labelled URLs.
ALLOWED = """
https://www.citylibrary.example/catalogue/history
https://docs.opensource.example/guide/install.html
https://news.daily.example/2024/03/politics/budget
https://blog.gardening.example/posts/tomatoes-in-spring
https://www.university.example/research/physics/papers
https://wiki.encyclopedia.example/wiki/Ocean_currents
https://museum.example/collections/ancient-greece
https://www.health.example.gov/advice/vaccines
https://forum.cooking.example/thread/1234-bread-baking
https://school.example.edu/courses/mathematics/algebra
https://archive.newspaper.example/1998/article/5521.html
https://help.software.example/en/articles/9931
https://recipes.homekitchen.example/soups/lentil
https://science.magazine.example/articles/2023/climate
https://travel.notes.example/guides/lisbon
https://www.weather-service.example/de/forecast/berlin
https://books.reading.example/en/reviews/novels
https://www.law.example.gov/statutes/chapter-12
https://www.court.example.gov/opinions/2019/77
https://blog.astronomy.example/2022/saturn-rings
https://journal.medicine.example/en/issue/7/article/3
https://stories.children.example/tales/the-fox
https://poetry.archive.example/poems/winter
https://economics.example.edu/papers/trade
https://developer.platform.example/docs/api/reference
https://manual.database.example/current/sql/select.html
https://www.parliament.example.gov/debates/2021/education
https://lectures.example.edu/history/roman-empire/notes
https://blog.engineer.example/2020/11/compiler-design
https://www.nature-society.example/birds/robin
https://genealogy.example/records/parish/1850
https://maps.geography.example/atlas/rivers/danube
https://questions.programming.example/questions/4412/sorting-a-list
https://www.publicradio.example/programmes/science-hour
https://encyclopedia.music.example/composers/bach
https://tutorials.drawing.example/lessons/perspective
https://www.hospital.example/departments/cardiology
https://www.railway-museum.example/engines/steam
https://review.films.example/2018/documentary/oceans
https://grammar.language.example/lessons/verbs/past-tense
https://www.theatre.example/season/plays
https://statistics.example.gov/population/census
https://chess.example/openings/italian-game
https://www.botanic-garden.example/plants/orchids
https://philosophy.example.edu/entries/ethics
https://dictionary.example/words/serendipity
https://letters.archive.example/1912/correspondence
https://www.charity.example/reports/annual-2022
http://blog.oldmaps.example.org/en/4410
https://www.village-school.example.net/de/871.html
http://m.trainride.example.net/fr/2093
https://cooking.example.com/es/318/
http://www.riverside.example.org/en/77
https://blog.mathnotes.example.com/de/5120
https://m.birdsong.example.net/en/964
http://handwriting.example.org/fr/1207.html
https://www.northlight.example.net/es/2286
http://blog.weaving.example.com/en/643/
https://stonebridge.example.org/de/3975
http://m.lighthouse.example.net/en/58.html
https://www.orchestra.example.org/fr/490/
http://blog.thinking.example.net/en/1530
https://m.another-day.example.org/es/702
http://shorelines.example.com/en/2648
https://www.eastern-history.example.org/en/3120
https://interesting.example.net/de/1411
https://m.horticulture.example.com/en/205
https://blog.weathering.example.org/fr/3307
https://www.northern.example.net/en/1876.html
https://international.example.com/en/932/
https://blog.potential.example.net/es/410
https://m.reading-room.example.org/en/2750
https://www.information.example.com/de/68
https://therapist.example.net/en/3994
https://blog.station.example.org/en/1023/
https://www.handbook.example.net/fr/86
https://m.sustainable.example.com/en/4521
https://brotherhood.example.org/de/333.html
https://blog.threshold.example.net/en/2089
https://www.attention.example.com/en/776
https://m.understanding.example.org/es/1602
https://forest-rangers.example.net/en/518/
https://www.leather.example.com/fr/2430
https://blog.another-tale.example.org/en/47
https://m.motherland.example.net/de/3760
https://www.enterprise.example.org/en/1199
https://ballooning.example.com/en/640.html
https://blog.estate.example.net/fr/4012
https://m.table-tennis.example.org/en/2981
https://www.southern.example.com/es/159
https://nations.example.net/en/3475/
https://blog.tradition.example.org/de/1854
https://m.ornithology.example.com/en/90
https://www.edition.example.net/en/2217
https://thunder.example.org/fr/731
https://blog.tenants.example.com/en/3608.html
https://m.breath.example.net/en/1340
https://www.rehearsal.example.org/de/2566
https://shelter.example.com/en/417/
https://blog.hearing.example.net/es/3082
https://m.erosion.example.org/en/1745
https://www.anthology.example.com/fr/263
https://onset.example.net/en/4190
https://blog.author-notes.example.org/en/528
""".split()
BLOCKED = """
http://free-casino-bonus.example/win/slots?play=1
http://cheap-pills-online.example/buy/viagra
http://xxx-hot-videos.example/watch/adult
http://download-crack-keygen.example/full/torrent
http://ads.tracker.example/click/banner/redirect
http://login-verify-account.example/secure/update/password
http://win-free-iphone.example/claim/prize
http://adult-dating-now.example/join/free/sex
http://fast-loans-approved.example/apply/cash
http://poker-jackpot-777.example/bonus/spin
http://replica-watches-sale.example/shop/cheap/rolex
http://torrent-movies-hd.example/download/free
http://crypto-double-profit.example/invest/bonus
http://seo-backlinks-cheap.example/buy/links
http://porn-tube-free.example/videos/xxx
http://spyware-removal-now.example/download/scan.exe
http://betting-odds-live.example/casino/free-bet
http://bank-secure-login.example/verify/card
http://miracle-weight-loss.example/buy/pills/discount
http://click-tracker.example/ad/redirect/offer
http://free-gift-cards.example/claim/offer/win
http://escort-girls-city.example/adult/book
http://cheap-followers.example/buy/likes
http://keygen-serials.example/crack/windows
http://casino-royal-slots.example/play/roulette/bonus
http://buy-cialis-cheap.example/pills/order/now
http://hot-sex-cams.example/live/girls/free
http://warez-full-download.example/crack/patch
http://adserver.popunder.example/banner/click
http://account-suspended-alert.example/login/verify/password
http://lottery-winner-claim.example/prize/cash
http://adult-xxx-pics.example/gallery/nude
http://payday-loan-fast.example/apply/approved
http://online-poker-free.example/jackpot/win
http://fake-designer-bags.example/replica/sale
http://pirate-torrents.example/movies/download/hd
http://bitcoin-profit-bot.example/double/invest
http://buy-backlinks-seo.example/cheap/traffic
http://free-porn-movies.example/xxx/tube
http://virus-alert-scan.example/download/cleaner.exe
http://sports-betting-tips.example/odds/bet/free
http://paypal-secure-verify.example/login/update
http://lose-weight-fast-pills.example/discount/buy
http://popup-ads-network.example/redirect/click/offer
http://free-iphone-giveaway.example/win/claim
http://escorts-adult-service.example/girls/book
http://buy-instagram-likes.example/followers/cheap
http://serial-keygen-crack.example/download/full
http://blog.best-casino.example.org/en/4127
http://www.spam-offers.example.net/de/902.html
http://m.link-farm.example.net/fr/2214
http://pills-shop.example.com/es/377/
http://www.adult-videos.example.org/en/81
http://blog.bets-online.example.com/de/5033
http://m.ads-server.example.net/en/918
http://track-clicks.example.org/fr/1260.html
http://www.xxx-pics.example.net/es/2301
http://blog.win-cash.example.com/en/655/
http://cheap-loans.example.org/de/3899
http://m.free-spins.example.net/en/49.html
http://www.spam-mailer.example.org/fr/512/
http://blog.farm-links.example.net/en/1498
http://m.poker-win.example.org/es/688
http://adult-chat.example.com/en/2702
""".split()


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        rule_host, rule_path = text.split("/", 1)
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(column: pa.Array, seed: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of a string column."""
    raw, at = utf8(column)
    rows, found = [], []
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in ORDERS:
        if len(raw) < n:
            continue
        code = raw.astype(np.uint64)
        for _ in range(n - 1):
            code = code[:-1] * np.uint64(257) + raw[len(raw) - len(code) + 1 :]
        inside = owner[: len(code)] == owner[n - 1 :]
        code = (code[inside] + np.uint64(seed * 10 + n)) * np.uint64(0x9E3779B97F4A7C15)
        rows.append(owner[: len(inside)][inside])
        found.append(((code ^ (code >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sums(host: pa.Array, path: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The mean weight of each row's n-grams."""
    total, count = np.zeros(len(host)), np.zeros(len(host))
    for seed, column in ((1, host), (2, path)):
        rows, found = _grams(column, seed, len(weights))
        total += np.bincount(rows, weights[found], len(host))
        count += np.bincount(rows, minlength=len(host))
    return total / np.maximum(count, 1)


def fit(hosts: list[str], paths: list[str], blocked: list[bool], buckets: int = BUCKETS, rounds: int = 400, rate: float = 8.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, by gradient descent from zero; both classes weigh the same, however many labels each has."""
    x, y = np.zeros((len(hosts), buckets)), np.array(blocked, dtype=float)
    for seed, column in ((1, hosts), (2, paths)):
        np.add.at(x, _grams(pa.array(column, pa.string()), seed, buckets), 1.0)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    each = np.where(y > 0, len(y) / 2 / max(1, y.sum()), len(y) / 2 / max(1, len(y) - y.sum()))
    w, b = np.zeros(buckets), 0.0
    for _ in range(rounds):
        miss = each * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= rate * (x.T @ miss + decay * w)
        b -= rate / len(y) * miss.sum()
    return w, b


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: np.ndarray, bias: float) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of ``pages`` (page_id, url)."""
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    model = pages.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = model.value
        for batch in batches:
            score = 1 / (1 + np.exp(-(_sums(batch.column("host"), batch.column("path"), w) + b)))
            own = batch.column("verdict").to_pylist()
            verdict = pa.array([v or ("block" if s >= 0.5 else "allow") for v, s in zip(own, score, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], verdict, pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "block_score"])

    return parts.select("*", rule.alias("rule"), verdict.alias("verdict")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, block_score double"
    )


def fit_labelled() -> tuple[np.ndarray, float]:
    """The regression of the labelled table above."""
    cut = [u.split("://", 1)[1] for u in ALLOWED + BLOCKED]
    hosts = [c.partition("/")[0].lower() for c in cut]
    paths = ["/" + c.partition("/")[2].split("?")[0].split("#")[0] for c in cut]
    return fit(hosts, paths, [False] * len(ALLOWED) + [True] * len(BLOCKED))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, *fit_labelled())
