"""URL filter: path rules, then logistic regression on hashed character n-grams of host and path.

The model is trained on a small table of labelled URLs (LABELLED and ``varied``, or the caller's) in its dual form: the
weights are a sum of the training rows, so gradient descent keeps one number per row, over the matrix of
their products.  Table, matrix and descent are one SQL expression over one row, so no rows are joined.
The weights (BUCKETS numbers) become a constant of the scoring expression, so ``pages`` is scored in the
scan, without a shuffle.  A URL's vector has the counts of its n-grams, divided by their length.

Cases with a defined result
    null URL, or none with ``://``: host and path empty, no rule; the model judges the empty strings
    rules: the longest that fits; its host fits itself and its subdomains; of equally long ones, the
        first in the list
    very long URL: judged whole; time grows with its length (n log n)
    null or repeated ids, extra columns of any name: each row is judged on its own URL
    empty table: an empty result; no labelled rows: every URL has the probability one half
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS, SIZES = 8192, (3, 4, 5)
EPOCHS, RATE, PENALTY = 200, 0.12, 0.01
#: Square of the constant feature.
CONSTANT = 0.1
CUT = 0.45

#: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: The labelled URL table: wanted (0) and unwanted (1) sites, as a person would list them.
LABELLED = (
    ("www.cityarchive.org", "/history/1912", 0), ("blog.gardener.com", "/2019/roses-in-may", 0), ("docs.compiler.net", "/tutorial/loops.html", 0),
    ("news.harbour.com", "/economy/article-221", 0), ("weather.bureau.gov", "/today", 0), ("www.library.edu", "/catalog/88", 0),
    ("recipes.kitchen.com", "/soup/leek-and-potato", 0), ("www.mathforum.net", "/question/77", 0), ("en.encyclopedia.org", "/wiki/River", 0),
    ("support.printers.com", "/manual/201.html", 0), ("www.townhall.de", "/amt/bauen", 0), ("teacher.fr", "/cours/31", 0),
    ("museum.northern.com", "/exhibit/65", 0), ("m.tramlines.net", "/horario", 0), ("www.travelnotes.com", "/reise/alpen", 0),
    ("forum.sailing.org", "/thread/915", 0), ("science.letters.net", "/article/42", 0), ("www.orchestra.com", "/season/programme", 0),
    ("hiking.mountain.org", "/sentier/19", 0), ("blog.stonework.com", "/en/733", 0), ("university.ac.uk", "/physics/research", 0),
    ("radio.eastern.com", "/show/morning", 0), ("notes.economist.org", "/es/60", 0), ("www.theatre.net", "/saison/18", 0),
    ("hospital.org", "/visitors/parking", 0), ("school.edu", "/pupils/calendar.html", 0), ("parliament.gov", "/debates/2021/4", 0),
    ("chess.club", "/openings/sicilian", 0), ("bakery.shop", "/bread", 0), ("linguistics.institute.org", "/en/papers/301", 0),
    ("astronomy.observatory.net", "/images/9", 0), ("carpenter.com", "/de/werkstatt/145.html", 0),
    ("cheap-meds.com", "/order/17", 1), ("www.buy-pills-online.net", "/discount", 1), ("casino-royal.com", "/bonus/5", 1),
    ("m.free-spins.net", "/win/33", 1), ("bets-now.com", "/odds/41", 1), ("www.sports-betting.org", "/free-bet/6", 1),
    ("ads-server.net", "/click/91", 1), ("track.ad-network.com", "/pixel/12", 1), ("spam-links.org", "/page/7", 1),
    ("link-farm.com", "/de/503", 1), ("hot-xxx-cams.net", "/live/21", 1), ("www.adult-videos.com", "/top/66", 1),
    ("free-porn.org", "/en/8", 1), ("sexy-chat.net", "/room/15", 1), ("payday-loans.com", "/apply/2", 1),
    ("www.cheap-loan-offers.net", "/en/90", 1), ("win-prize.com", "/claim/44", 1), ("free-iphone-deals.org", "/now/3", 1),
    ("replica-watches.net", "/cheap/120", 1), ("www.warez-crack.com", "/keygen/72", 1), ("malware-download.org", "/setup.exe", 1),
    ("phish-login.net", "/bank/verify", 1), ("m.viagra-shop.com", "/pills/1", 1), ("www.jackpot-slots.net", "/free/29", 1),
    ("clickbait-farm.com", "/shock/55", 1), ("ad-track.com", "/banner/301", 1), ("best-casino-bets.com", "/es/4", 1),
    ("lottery-winner.net", "/claim", 1), ("cheap-cigarettes.com", "/fr/order/9", 1), ("online-poker-bonus.org", "/table/2", 1),
    ("weight-loss-pills.com", "/trial", 1), ("crypto-doubler.net", "/deposit", 1),
)

#: Words that ordinary and unwanted sites are called by, for ``varied``.
PLAIN_WORDS = (
    "garden library museum weather school harbour kitchen theatre valley orchard bridge station village market forest letters journal science history music "
    "travel housing parents teachers farming fishing cycling sailing poetry physics nursing railway pottery council archive pharmacy dentist bakery hotel review"
).split()
SPAM_WORDS = "casino viagra pills porn xxx adult bet poker jackpot lottery prize replica warez crack malware phish spam ads track click loans payday cams escort hack cheap free win bonus farm".split()
_SUBDOMAINS, _ENDS = ("", "www.", "blog.", "m.", "news.", "shop."), (".com", ".org", ".net", ".de", ".info", ".example.com", ".example.org", ".example.net")
_PATHS = ("/", "/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/page/{n}", "/{n}/index.html", "/archive/{n}", "/item-{n}", "/a/{n}/b")
_ONSETS, _RESTS = "b c d f g h k l m n p r s t v w st tr br th sh".split(), "an er in on el at is or um ea io ai ent our all est".split()


def varied(each: int = 60) -> tuple[tuple[str, str, int], ...]:
    """``each`` unwanted and twice as many ordinary URLs by rule, with the same endings, subdomains and paths on both sides,
    so that only the names tell them apart: two of SPAM_WORDS, or words of PLAIN_WORDS and invented names."""
    rows = []
    for k in range(each):
        syllable = lambda n: _ONSETS[n % len(_ONSETS)] + _RESTS[n // 3 % len(_RESTS)]
        invented = "".join(syllable(7 * k + 11 * j) for j in range(2 + k % 2))
        plain = PLAIN_WORDS[k % len(PLAIN_WORDS)] + ("-" + PLAIN_WORDS[(k + 7) % len(PLAIN_WORDS)] if k % 2 else "")
        bad = SPAM_WORDS[k % len(SPAM_WORDS)] + ("-" if k % 3 else "") + (SPAM_WORDS[(5 * k + 3) % len(SPAM_WORDS)] if k % 5 else "x" if k % 2 else invented[:4])
        for name, label in ((invented, 0), (plain, 0), (bad, 1)):
            rows.append((_SUBDOMAINS[k % len(_SUBDOMAINS)] + name + _ENDS[k % len(_ENDS)], _PATHS[k % len(_PATHS)].format(n=37 * k % 9973), label))
    return tuple(rows)


#: Rows that one task trains on; more have to be thinned by the caller.
MAX_LABELLED = 2_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url) -> F.Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return F.coalesce(host, F.lit(""))


def path_of(url) -> F.Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host, path, rules=RULES) -> F.Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    fits = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        this = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(this, found) if fits is None else fits.when(this, found)
    return fits


def grams(host, path) -> F.Column:
    """Buckets of the character n-grams of host and path, each with its ends marked."""
    def bucket(tag: str):
        return lambda gram: F.pmod(F.xxhash64(F.lit(tag), gram), F.lit(BUCKETS)).cast("int")

    parts = []
    for tag, text in (("h", host), ("p", path)):
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        # a look ahead finds overlapping grams in one walk over the text
        parts += [F.transform(F.regexp_extract_all(marked, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)), bucket(tag)) for size in SIZES]
    return F.concat(*parts)


#: Length of the vector of counts of an array b of buckets: equal ones stand side by side, and the n-th of them adds 2n - 1.
_LENGTH = (
    "sqrt(aggregate(array_sort({b}), named_struct('p', -1, 'r', 0, 't', 0L), (a, x) -> named_struct('p', x, 'r', if(x = a.p, a.r + 1, 0),"
    " 't', a.t + 1 + 2 * if(x = a.p, a.r + 1, 0)), a -> greatest(a.t, 1L)))"
)


def train(spark: SparkSession, labelled=None) -> list[float]:
    """Weights by bucket, with the intercept last, of ``labelled`` (host, path, 0 or 1), MAX_LABELLED rows at most; by
    default LABELLED and ``varied``."""
    labelled = LABELLED + varied() if labelled is None else labelled
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"{len(labelled)} labelled rows; one task trains on {MAX_LABELLED} at most")
    if not labelled:
        return [0.0] * (BUCKETS + 1)
    quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
    table = "array(" + ", ".join(f"named_struct('host', {quoted(h)}, 'path', {quoted(p)}, 'y', {float(y)}D)" for h, p, y in labelled) + ")"
    one = spark.range(1).select(F.transform(F.expr(table), lambda r: F.struct(r["y"].alias("y"), grams(r["host"], r["path"]).alias("b"))).alias("rows"))
    # each row's buckets with their counts, divided by its length
    one = one.selectExpr(f"""transform(rows, r -> named_struct('y', r.y, 'v', transform(array_distinct(r.b), x ->
      named_struct('b', x, 'v', size(filter(r.b, z -> z = x)) / {_LENGTH.format(b='r.b')})))) AS rows""")
    # products of the rows, to each of which the constant feature adds CONSTANT; what a loop reads again and again is
    # bound to a name of its own (transform over one element), so it is computed once
    one = one.selectExpr("rows", f"""transform(array(transform(rows, r -> map_from_entries(r.v))), maps ->
      transform(rows, r -> transform(maps, m -> aggregate(r.v, {CONSTANT}D, (s, e) -> s + e.v * coalesce(m[e.b], 0D)))))[0] AS lines""")
    descent = f"""transform(array(named_struct('lines', lines, 'y', transform(rows, r -> r.y))), q ->
      aggregate(sequence(1, {EPOCHS}), transform(q.y, y -> 0D), (a, e) ->
        transform(q.lines, (line, n) -> a[n] - {RATE} * ({PENALTY} * a[n] - q.y[n]
          + 1 / (1 + exp(-aggregate(zip_with(line, a, (k, w) -> k * w), 0D, (s, t) -> s + t)))))))[0]"""
    trained = one.selectExpr("rows", f"{descent} AS a")
    entries = f"transform(array(a), a -> transform(rows, (r, n) -> transform(concat(r.v, array(named_struct('b', {BUCKETS}, 'v', {CONSTANT}D))), e -> named_struct('b', e.b, 'w', e.v * a[n]))))[0]"
    weights = trained.selectExpr(f"inline(flatten({entries}))").groupBy("b").agg(F.sum("w").alias("w"))
    out = [0.0] * (BUCKETS + 1)
    for r in weights.collect():  # BUCKETS + 1 rows at most
        out[r["b"]] = r["w"]
    return out


def scored(rows: DataFrame, weights: list[float], host: str = "host", path: str = "path") -> DataFrame:
    """``rows`` with score, the model's probability that a URL is unwanted."""
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")  # folded into one constant
    total = F.aggregate("_b", F.lit(0.0), lambda s, i: s + F.get(table, i)) / F.expr(_LENGTH.format(b="_b"))
    return rows.withColumn("_b", grams(F.col(host), F.col(path))).withColumn("score", 1 / (1 + F.exp(-(total + F.lit(weights[BUCKETS]))))).drop("_b")


def judge(pages: DataFrame, weights: list[float], id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    rows = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    rows = scored(rows, weights).withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    by_model = F.when(F.col("score") >= CUT, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", by_model).alias("verdict"), "score")
