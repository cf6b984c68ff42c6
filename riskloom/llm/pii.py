"""Personal data by candidate gradient boosting, in DataFrame operations and JVM model training.

1. Fixed patterns find emails, addresses, card numbers and phone numbers and
   check them (address parts, Luhn sum, number of digits).  What passes is
   always reported.
2. High-recall generators propose further, overlapping spans: groups inside a
   rejected run of digits, written phone numbers with and without a plus, and
   long mixed tokens.
3. Boosted trees learn from the format and context of the candidates that a
   fixed rule decides (a bounded sample), and score all candidates.
4. Per kind, a threshold is calibrated on held-out candidates.  Spans above it
   that overlap no reported span are added; of overlapping ones the best stays.

Kinds in order: email, ip, card, phone, secret.  Positions are code points, the
end exclusive.  A pattern is matched at the first place of its run only, with
possessive repeats, so matching is linear in the text.

Defined results: a null or empty text has no spans; texts of any length are
read whole; rows equal in doc_id and text share one result; a table without
candidates of both labels adds no span.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import shared_dir

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE_CANDIDATES = 20_000
ROUNDS = 12
DEPTH = 3
PRECISION = 0.99
LEAST_SCORE = 0.8  # no threshold is lower

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
CARD_GROUPS = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
PHONE_LAYOUT = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"
ASSIGNED = r"(?i)(?:token|key|secret|password|passwd)\s*[=:]\s*[\"']?$"
CONTEXT = 24

# kind, whether the fixed rules decide the span, pattern, and what a text must hold for the pattern to match
GENERATORS = (
    (0, True, EMAIL, "@"), (1, True, IP, "."), (2, True, CARD, ""), (3, True, PHONE, "+"),
    (2, False, CARD_GROUPS, ""), (3, False, PHONE_LAYOUT, ""), (4, False, SECRET, ""),
)
FEATURES = ("kind", "length", "digits", "letters", "capitals", "gaps", "plus", "round", "luhn", "octets", "before", "after", "assigned", "distinct")


def _matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before, after): positions from the lengths of the pieces between matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    raw = F.transform(found, lambda m, i: F.struct(
        F.length(F.get(gaps, i)).alias("gap"), m.alias("match"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")))
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.aggregate(raw, empty, place, lambda acc: acc["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a digit string is a multiple of ten."""
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    values = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.coalesce(F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0, F.lit(False))


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).try_cast("int") <= 255))


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, _octets(match))
        .when(kind == 2, (n >= 13) & (n <= 19) & _luhn(digits))
        .otherwise((n >= 9) & (n <= 15))
    )


def _side(char: Column) -> Column:
    """0 nothing or space, 1 letter, 2 digit, 3 anything else."""
    return F.when((char == "") | char.rlike(r"^\s$"), 0).when(char.rlike(r"^\p{L}$"), 1).when(char.rlike("^[0-9]$"), 2).otherwise(3)


def _spans(text: Column, kind: int, fixed: bool, pattern: str, needed: str) -> Column:
    """Matches of one generator; its pattern runs only on texts that hold what it needs."""
    spans = F.transform(_matches(text, pattern), lambda m: F.struct(
        F.lit(kind).alias("kind"), F.lit(fixed).alias("fixed"), *[m[c].alias(c) for c in ("start", "end", "match", "before", "after")]))
    empty = F.array().cast("array<struct<kind:int,fixed:boolean,start:int,end:int,match:string,before:string,after:string>>")
    return F.when(F.contains(text, F.lit(needed)) if needed else text.rlike("[0-9]"), spans).otherwise(empty)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, found): all base matches and proposed spans of each text, without the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = [_spans(text, *generator) for generator in GENERATORS]
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"), F.concat(*parts).alias("found"))


def _features(spans: DataFrame) -> DataFrame:
    """One row per span with its features, the verdict of the fixed rules and a label where a rule decides."""
    match, digits = F.col("match"), _digits(F.col("match"))
    made = spans.withColumn("valid", F.col("fixed") & _valid(F.col("kind"), match)).withColumns({
        "length": F.length(match), "digits": F.length(digits),
        "letters": F.length(F.regexp_replace(match, "[^A-Za-z]", "")), "capitals": F.length(F.regexp_replace(match, "[^A-Z]", "")),
        "gaps": F.length(F.regexp_replace(match, r"[^ ().@_-]", "")), "plus": match.startswith("+").cast("int"),
        "round": match.contains("(").cast("int"), "luhn": _luhn(digits).cast("int"), "octets": F.when(F.col("kind") == 1, _octets(match)).otherwise(False).cast("int"),
        "assigned": F.col("before").rlike(ASSIGNED).cast("int"), "distinct": F.size(F.array_distinct(F.split(match, ""))),
    }).withColumn("before", _side(F.right("before", F.lit(1)))).withColumn("after", _side(F.col("after")))
    decided = F.when(F.col("fixed"), F.col("valid").cast("double")).when(F.col("kind") == 4, F.col("assigned").cast("double"))
    return made.withColumn("label", decided).drop("match")


def _taught(spans: DataFrame) -> DataFrame:
    """Secrets are labelled by their context, so the trees must judge them by format: the context feature is hidden from them."""
    return spans.withColumn("assigned", F.when(F.col("kind") == 4, 0).otherwise(F.col("assigned")))


def _scored(spans: DataFrame, sample: int) -> DataFrame:
    """Spans with a score and whether it reaches the threshold of their kind."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_taught(spans))
    labelled = rows.where(F.col("label").isNotNull()).select("label", "kind", "features", F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(5)).alias("fold"))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return spans.withColumn("score", F.lit(0.0)).withColumn("accepted", F.lit(False))
    chosen = labelled.sample(min(1.0, sample / sum(sizes.values())), seed=3)
    trained = chosen.where("fold <> 0")
    if trained.select("label").distinct().count() < 2:
        return spans.withColumn("score", F.lit(0.0)).withColumn("accepted", F.lit(False))
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=32).fit(trained)

    def judged(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("score", F.round(vector_to_array("probability")[1], 9))

    held = judged(labelled.where("fold = 0")).groupBy("kind", "score").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("kind").orderBy(F.col("score").desc())
    precise = held.withColumn("share", F.sum("right").over(down) / F.sum("n").over(down)).where(F.col("share") >= PRECISION)
    cut = {r["kind"]: max(LEAST_SCORE, r["cut"]) for r in precise.groupBy("kind").agg(F.min("score").alias("cut")).collect()}
    threshold = F.lit(2.0)
    for number, value in cut.items():
        threshold = F.when(F.col("kind") == number, F.lit(value)).otherwise(threshold)
    return judged(rows).select(*spans.columns, "score").withColumn("accepted", F.col("score") >= threshold)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_CANDIDATES) -> DataFrame:
    """(doc_id, base, extra): per row the spans of the fixed rules and those the trees add, as arrays of (kind, start, end, score)."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "pii")
    candidates(docs, id_col, text_col).write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    _features(found.dropDuplicates(["doc_id", "digest"]).where(F.size("found") > 0).select("doc_id", "digest", F.explode("found").alias("s")).select("doc_id", "digest", "s.*")).write.parquet(f"{folder}/spans")
    spans = spark.read.parquet(f"{folder}/spans")
    scored = _scored(spans, sample).where(F.col("valid") | (F.col("accepted") & ~F.col("fixed")))
    best = scored.select("doc_id", "digest", "kind", "start", "end", F.when(F.col("valid"), F.lit(2.0)).otherwise(F.col("score")).alias("score"), "valid")
    doc = Window.partitionBy("doc_id", "digest")
    reach = F.max("end").over(doc.orderBy("start", "end", "kind", "valid").rowsBetween(Window.unboundedPreceding, -1))
    runs = best.withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(doc.orderBy("start", "end", "kind", "valid").rowsBetween(Window.unboundedPreceding, 0)))
    first = F.row_number().over(Window.partitionBy("doc_id", "digest", "run").orderBy(F.col("score").desc(), F.col("end") - F.col("start"), "start", "kind"))
    kept = runs.withColumn("rank", first).where(F.col("valid") | (F.col("rank") == 1))
    span = F.struct("kind", "start", "end", "score")
    per_doc = kept.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("d")).agg(
        F.array_sort(F.collect_list(F.when(F.col("valid"), span))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("valid"), span))).alias("extra"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int,score:double>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("digest"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("extra", none).alias("extra"))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per kind of the fixed rules, the digest of their spans, and all spans as text."""
    found = find_pii(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_added"),
    )
