"""URL filter: rules by host suffix and path prefix, then a logistic regression.

The regression works on hashed character n-grams of host and path and is trained
on a small labelled table of URLs, EXAMPLES. A rule fits its host and all
subdomains where the path starts with the rule's; the longest one that fits
decides, and the regression judges the URLs that no rule fits.

Defined results: a null URL, or one without "://", has an empty host and path
and is judged by the regression's bias alone, which the table's wanted address
without both keeps below zero; rows that repeat are judged each; an address of any
length is read whole; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.shared import map_arrow

#: (host, path, verdict) (fixed values).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

#: The labelled URL table, invented: unwanted ones, then wanted ones. The address without host and path is the last.
UNWANTED = """
golden-casino.test/play casino-lounge.test/bonus grand-casino.test/slots/7 mycasino.test/win www.casino-nights.test/spin casino24.test/en/3 m.casinoland.test/de/80 the-casino.example/fr/5
betting-tips.test/odds bets4all.test/today livebets.test/football betmaster.test/free-bets superbets.test/welcome bets-and-odds.test/en/12 www.free-bets.example/tips betting.example/odds
spamhub.test/seo spam-network.test/buy-links spam-pages.test/en/51 blogspam.test/cheap m.spam-mill.example/de/6 linkfarm.test/cheap-links link-farms.test/fr/8 farm-of-links.test/3 content-farm.test/spin/12 seo-farm.test/backlinks buy-backlinks.example/seo cheap-links.example/buy
adults-only.test/free adult-movies.test/hd adult-zone.test/live adultvideo.example/es/7 xxx-stream.test/watch xxxtube.test/en/2 live-xxx.example/cams hotsex.test/cams sexchat.test/girls sex-movies.example/free
porn-archive.test/tube pornvideos.test/hd freeporn.example/watch porntube.test/en/44 camgirls.test/live girls-on-cams.example/xxx
viagra-store.test/cheap cheap-viagra.test/order viagra.example/buy buycialis.test/order cialis-shop.test/pills pharma-discount.test/pills cheap-pills.test/pharma pillsonline.test/no-prescription mypills.example/order cheapmeds.test/viagra
quickloans.test/payday payday-cash.test/apply instant-loans.test/cash paydaynow.example/loans loans-today.example/money prizewinner.test/claim claim-your-prize.test/win freemoney.test/now easy-money.example/cash lotteryprize.test/jackpot lottery-winner.example/claim win-lottery.test/en/9
pokerstars-bonus.test/poker online-poker.test/tables pokerroom.example/play jackpotcity.test/slots jackpot-party.test/spins slotmachine.test/free-spins best-slots.test/spin slots-online.example/bonus
warezland.test/crack warez-files.test/en/1 keygens.test/serial keygen-crack.example/download torrentz.test/cracked torrent-files.test/crack cracked-games.example/torrent fake-watches.test/replica replicabags.test/cheap replica-shop.example/watches
"""
WANTED = """
gazette.test/politics/2023/12 handbook.test/install/linux catalogue.test/books/118 college.test/research/papers gallery.test/visit/hours forecast.test/today cooking.test/bread/rye gardening.test/plants/rose
townhall.test/council/minutes clinic.test/nutrition lexicon.test/History_of_art classroom.test/lessons/4 orchestra.test/concerts voyage.test/fr/lyon diary.test/2020/06/post meeting.test/thread/17
atlas.test/region/9 physics.test/waves project.test/readme bookshop.test/novels/31 www.neighbourhood.test/index.html m.gazette.test/about blog.baker.test/de/204 en.lexicon.test/en/5512
www.museum-town.test/es/77 parliament.test/debates/1998 library-north.test/en/81 stories.test/fr/42 www.mountain.test/trails/map river.test/en/fishing weatherman.test/de/12.html observatory.test/stars/5
theatre.test/programme kitchen.test/es/sopa m.railway.test/timetable farmers.test/markets/spring children.test/games/chess winter.test/sports/ski bank-holiday.test/dates best-of-poetry.test/sonnets
www.gazette.example/en/3 news-daily.test/world/2022 m.news.example/de/80 blog.harbour.test/fr/5 the-harbour.example/boats forest-walks.test/tips today.example/today football-club.test/results
film-archive.test/en/12 cinema.example/programme online-atlas.test/maps school-online.example/en/2 my-garden.test/order/of/roses tables-and-chairs.test/shop watchmakers.test/history clockwork.example/watches
seaside.test/beaches village.test/en/9 national-park.example/visit bridge.test/engineering mathematics.test/proofs/7 logic.example/es/7 algebra.test/lessons chemistry.test/elements/12
www.hospital.test/departments doctors.example/en/44 nurses.test/careers pharmacy-guild.test/history tax-office.test/forms post-office.example/stamps court.test/rulings/2019 law-review.example/fr/8
m.theatre.example/play playground.test/children players.test/chess bookkeeping.test/courses/1 bakery.test/cakes dairy.example/cheese orchard.test/apples vineyard.example/de/6
www.astronomy.test/planets geology.test/rocks oceans.example/tides climate.test/data/1990 energy.test/wind bicycle.test/repair motorway.test/en/51 airport.example/arrivals
painter.test/portraits sculpture.example/bronze weaving.test/looms pottery.test/glazes violin.example/makers choir.test/concerts opera.example/en/1 folk-songs.test/lyrics
history-society.test/archive/3 genealogy.test/names castles.example/es/31 monastery.test/abbey runes.test/stones language.test/grammar dictionary.example/en/words spelling.test/rules
"""

SIZE = 1 << 14
ORDERS = (3, 4, 5)


def features(host: str, path: str) -> np.ndarray:
    """Hashed character n-grams of host and path, each once; digits count alike."""
    out = set()
    for tag, part in (("h", f"^{host}$"), ("p", f"^{path}$")) if host or path else ():
        part = "".join("0" if c.isdigit() else c for c in part)
        for n in ORDERS:
            for i in range(len(part) - n + 1):
                out.add(zlib.crc32(f"{tag}{part[i : i + n]}".encode("utf-8", "surrogatepass")) % SIZE)
    return np.array(sorted(out), dtype=np.int64)


def examples() -> list[tuple[str, str, int]]:
    """The labelled table: (host, path, 1 if unwanted)."""
    rows = []
    for table, label in ((UNWANTED, 1), (WANTED, 0)):
        for url in table.split():
            host, _, path = url.partition("/")
            rows.append((host, "/" + path, label))
    return [*rows, ("", "", 0)]


def train(rows: list[tuple[str, str, int]], rounds: int = 400, rate: float = 0.5, penalty: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights; features are scaled so that a URL's length does not count."""
    xs = [features(h, p) for h, p, _ in rows]
    y = np.array([label for _, _, label in rows], dtype=float)
    at = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    cols = np.concatenate(xs).astype(np.int64)
    scale = np.repeat([1 / np.sqrt(max(len(x), 1)) for x in xs], [len(x) for x in xs])
    w, bias = np.zeros(SIZE), 0.0
    for _ in range(rounds):
        z = np.bincount(at, weights=w[cols] * scale, minlength=len(xs)) + bias
        g = y - 1 / (1 + np.exp(-z))
        w += rate * (np.bincount(cols, weights=g[at] * scale, minlength=SIZE) - penalty * len(xs) * w)
        bias += rate * g.sum() / len(xs)
    return bias, w


def score_urls(hosts: list[str], paths: list[str], bias: float, weights: np.ndarray) -> list[float]:
    """Log-odds of being unwanted; an address without host and path has no feature."""
    out = []
    for h, p in zip(hosts, paths):
        x = features(h, p)
        out.append(float(weights[x].sum() / np.sqrt(max(len(x), 1)) + bias))
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, by the first "://"."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(F.substring_index(F.substr(url, F.instr(url, F.lit("://")) + 3), "#", 1), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.when(F.instr(rest, "/") > 0, F.substr(rest, F.instr(rest, F.lit("/"))))
    empty = F.lit("")
    return F.when(found, host).otherwise(empty), F.when(found, F.coalesce(path, empty)).otherwise(empty)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labelled=None) -> DataFrame:
    """(id, host, path, rule, verdict, unwanted) of every row; unwanted is the regression's probability."""
    bias, weights = train(labelled or examples())
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    schema = rows.select("*", F.lit(0.0).alias("unwanted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array(score_urls(batch.column(1).to_pylist(), batch.column(2).to_pylist(), bias, weights), dtype=float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=schema.names)

    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("unwanted") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return map_arrow(rows, run, schema).select("id", "host", "path", name.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "unwanted")
