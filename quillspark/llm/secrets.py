"""Secret scans: fixed patterns, and tokens that a character model takes for random.

Two first-order Markov models over printable ASCII are trained from labelled samples, one from
random strings and one from ordinary identifiers. A maximal run of key characters scores the mean
log-likelihood ratio of its transitions; runs of 20 characters or more above CUT that overlap
no pattern match become `markov` spans. The whole path is DataFrame functions: pattern matches come
from one split and one extraction, positions from the running lengths of both, scores from an
array of the 128 x 128 ratios that is indexed by character codes. Running sums and maxima double
their reach step by step, so that the work on a text of n characters with k matches is in the
order of n + k log k: neither a megabyte of key characters nor 100,000 matches in a text are slow.

Kinds: assign (a named value of 6 characters or more), access (key ids of 20 or more), hex (24 or
more), markov. Base spans are the leftmost non-overlapping matches of each pattern by itself, so
spans of different base kinds may overlap; the model only adds. Spans are kind:start:end in code
points, end exclusive, ordered by start, then kind as listed.

Defined results: null and empty texts have no spans (empty string, and the hash of the empty
string); work is per row, so repeated rows get equal results and no key can be hot; other columns
are kept, whatever their names, and only a clashing `found` is replaced. An empty sample table gives ratios of 0 and so no
markov spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import documents

#: Fixed values of the contract, with letters in either case written out.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_VALUE = 6
#: Here the least lengths, 20 and 24, can stand in the pattern: shorter runs hold no match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
KINDS = (*BASE, "markov")

#: Runs that the model judges, and the mean log-likelihood ratio above which they are secrets.
RUN, CUT = "[A-Za-z0-9+/_=-]{20,}", 0.5
#: Characters of the models, and the count added to each transition.
CODES, SMOOTH = 128, 0.05
SAMPLES = 3000
#: Characters that rules and fillers repeat.
RULES = "-=_+/xXoOaA0179"
#: Parts of ordinary identifiers.
PARTS = (
    "get set read write load store user name file path index count total value item list table column row key map node tree graph query parse token text string number order price date time start end first last next previous parent child left right open close create delete update insert select filter group merge sort join split "
    "request response server client session cache buffer stream thread process event message handler service controller manager factory config option default version release build test error warning message debug info trace request header body status code result data model view template render format convert encode decode "
    "the and that with from this which have not for are was his her they there their would about other into more some than them these only over also after first where much through back years work because between right being under three never still while again should world house great every found those school thought country "
    "und der die das nicht ein eine mit auch sich auf werden haben sein schaft heit keit lich ung gen ver ent schreiben sprechen arbeit "
    "que les des une dans pour qui pas avec sont tion ment eau aux elle ier ation nous vous ils leur comme faire "
    "los las una con por para del como pero sus ando iendo cion mente idad ado ador aba amos entre cuando sobre todo"
).split()


def default_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """text, random: n rows of each label, made by rule from running numbers."""
    ids = spark.range(n)
    seeded = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(seeded("a")))
    random = F.when(F.col("id") % 4 == 0, seeded("b")).when(F.col("id") % 4 == 1, F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")).otherwise(base64)
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda k: F.element_at(parts, (F.pmod(F.crc32(F.concat(F.lit(f"p{k}-"), F.col("id").cast("string")).cast("binary")), F.lit(len(PARTS))) + 1).cast("int"))
    words = [part(k) for k in range(4)]
    caps = [F.initcap(w) for w in words]
    join = lambda by: F.concat_ws(by, *words)
    style = F.pmod(F.col("id"), F.lit(14))
    number = F.pmod(F.col("id") * 7919, F.lit(997)).cast("string")
    ordinary = (
        F.when(style < 2, join("_")).when(style < 4, F.concat(words[0], *caps[1:])).when(style == 4, F.upper(join("_"))).when(style == 5, join("-"))
        .when(style == 6, join("/")).when(style == 7, F.concat(*caps, number)).when(style == 8, F.upper(join(""))).when(style == 9, join(""))
        .when(style == 10, F.concat(F.lit("/"), words[0], F.lit("/"), words[1], F.lit("-"), words[2], F.lit("/"), words[3], F.lit("_"), number))
        .when(style == 11, F.repeat(F.element_at(F.split(F.lit(RULES), ""), (F.pmod(F.col("id"), F.lit(len(RULES))) + 1).cast("int")), F.lit(30)))
        .when(style == 12, F.concat(F.repeat(F.lit("-="), F.lit(6)), words[0], F.repeat(F.lit("=-"), F.lit(6)))).otherwise(F.concat_ws("/", words[0], number, words[1], number, words[2]))
    )
    return ids.select(random.alias("text"), F.lit(1).alias("random")).unionByName(ids.select(ordinary.alias("text"), F.lit(0).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratios of all transitions, row by row: CODES * CODES numbers."""
    clean = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    pairs = samples.select("random", F.explode(F.when(F.length(clean) > 1, F.transform(F.sequence(F.lit(1), F.length(clean) - 1), lambda i: F.substr(clean, i, F.lit(2))))).alias("pair"))
    a, b = F.ascii("pair"), F.ascii(F.substring("pair", 2, 1))
    counts = pairs.groupBy((a * CODES + b).alias("at")).agg(F.sum("random").alias("hit"), F.sum(1 - F.col("random")).alias("miss"))
    row = W.partitionBy(F.floor(F.col("at") / CODES))
    whole = lambda c: F.sum(c).over(row) + SMOOTH * CODES
    ratio = F.log((F.col("hit") + SMOOTH) / whole("hit")) - F.log((F.col("miss") + SMOOTH) / whole("miss"))
    # A transition that neither sample shows says nothing.
    out = [0.0] * (CODES * CODES)
    for r in counts.select("at", ratio.alias("ratio")).collect():
        out[r["at"]] = r["ratio"]
    return out


def bound(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, join) -> Column:
    """The array's running totals under `join` (of two Columns): every step joins each element with
    the one that is twice as far back as the step before did."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    farther = lambda done, back: F.transform(done, lambda x, i: F.coalesce(join(F.get(done, (i - back).cast("int")), x), x))
    return F.aggregate(steps, values, farther)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    pieces = F.filter(pieces, lambda p: p["match"].isNotNull())  # the last gap has no match after it

    def placed(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: p["gap"] + F.length(p["match"])), lambda x, y: x + y)
        return F.zip_with(pieces, ends, lambda p, end: F.struct((end - F.length(p["match"])).alias("start"), end.alias("end"), p["match"].alias("match")))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), bound(pieces, placed)).otherwise(none)


def clear_of(runs: Column, spans: Column) -> Column:
    """The runs that no span overlaps. In one order, runs by their end and spans by their start,
    the spans before a run are those that start in time; the largest end among them decides."""
    run = lambda m: F.struct(m["end"].alias("key"), F.lit(0).alias("span"), F.lit(-1).alias("until"), m["start"].alias("start"), m["match"].alias("match"))
    span = lambda m: F.struct(m["start"].alias("key"), F.lit(1).alias("span"), m["end"].alias("until"), m["start"].alias("start"), F.lit("").alias("match"))
    events = F.array_sort(F.concat(F.transform(runs, run), F.transform(spans, span)))

    def free(events: Column) -> Column:
        most = running(F.transform(events, lambda e: e["until"]), lambda x, y: F.greatest(x, y))
        known = F.zip_with(events, most, lambda e, until: F.struct(e["span"].alias("span"), until.alias("until"), F.struct(e["start"].alias("start"), e["key"].alias("end"), e["match"].alias("match")).alias("run")))
        return F.transform(F.filter(known, lambda k: (k["span"] == 0) & (k["until"] <= k["run"]["start"])), lambda k: k["run"])

    return F.when((F.size(runs) == 0) | (F.size(spans) == 0), runs).otherwise(bound(events, free))


def randomness(run: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    # One literal that the optimizer folds to an array, not thousands of expressions.
    table = F.split(F.lit(",".join(f"{r:.4f}" for r in ratios)), ",").cast("array<double>")
    n = F.length(run)
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    pairs = lambda c: F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: F.get(table, a * CODES + b))
    return F.aggregate(bound(codes, pairs), F.lit(0.0), lambda total, x: total + x) / (n - 1)


def find_secrets(docs: DataFrame, ratios: list[float], column: str = "text", cut: float = CUT) -> DataFrame:
    """Adds `found`: array<struct<start, nth, kind, end>> in order, nth the kind's place in KINDS."""
    text = F.coalesce(F.col(column), F.lit(""))
    # Names of our own beside the rows' columns, which come back from one struct.
    out = docs.drop("found").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "found"]).alias("row"), text.alias("text"))
    for kind, pattern in BASE.items():
        out = out.withColumn(kind, matches(F.col("text"), pattern))
    # A value too short for a match still takes its place: it is dropped after matching.
    value = lambda m: F.regexp_extract(m["match"], ASSIGN, 2)
    out = out.withColumn("assign", F.filter("assign", lambda m: F.length(value(m)) >= LEAST_VALUE))
    out = out.withColumn("runs", matches(F.col("text"), RUN))
    out = out.withColumn("runs", clear_of(F.col("runs"), F.concat(*[F.col(k) for k in BASE])))
    out = out.withColumn("markov", F.filter("runs", lambda m: randomness(m["match"], ratios) > cut))
    tagged = [F.transform(F.col(k), lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("nth"), F.lit(k).alias("kind"), m["end"].alias("end"))) for i, k in enumerate(KINDS)]  # noqa: B023
    return out.select("row.*", F.array_sort(F.concat(*tagged)).alias("found"))


def spelled(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = train(default_samples(spark))
    return digests(find_secrets(documents(spark, sf_dir).select("doc_id", "text"), ratios))
