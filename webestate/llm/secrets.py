"""Secret scans: token candidates, and a random forest that removes the false positives.

Candidates are the values right after a credential word and ``=`` or ``:``, quoted or up to the next white space, of at
least ``min_value`` characters of any kind, and elsewhere runs of at least ``min_chars`` of ``[A-Za-z0-9_+/-]``. Closing
punctuation does not belong to a value without quotes. Features of a finding:

- candidate length, and shares of digits, upper and lower case;
- character transitions: changes between character classes per character, and the mean log-probability of neighbouring
  characters under the dictionary;
- dictionary coverage: the share of three-letter pieces that dictionary words contain;
- path: candidates per document of the source that the finding comes from;
- neighbouring words: an assignment sign, a quote and a credential word just before, a quote just after.

The dictionary is every word that at least ``share`` of all documents hold. A document of n distinct words holds n
words, so there are at most (mean n) / ``share`` of them, whatever the number of documents. The forest is fitted on at
most about ``max_rows`` labelled findings (chosen by hash) and judges all findings. Everything is DataFrame operations.

Cases: null or empty text has no findings. Equal rows give equal findings. If labels hold one class or none, every
finding gets that class (none: secret). Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webestate.session import materialise

NEAR = 40
#: A code point that is no character.
MARK = "\ufdd0"
CREDENTIAL = r"(?i)(token|passw(or)?d|pwd|secret|api_?key|access_?key|auth|credential)"
#: What stands between a value and the credential word that it belongs to: the rest of a name, a sign, a quote.
NAMED = CREDENTIAL.replace("_?key", "[_-]?key") + r"(s|(?-i:[A-Z0-9_-])[A-Za-z0-9_-]{0,20})?[\"']?[ \t]{0,4}(:=|=>|==?|:)[ \t]{0,4}"
FEATURES = ("length", "digits", "uppers", "lowers", "turns", "fluency", "coverage", "path_rate", "assigned", "quoted", "credential", "closed")


def _value(min_value: int) -> str:
    """Pattern of a value after a credential word. The short look-behinds come first: they turn nearly every place away."""
    double, single, bare = (rf"(?<=[=:>][ \t]{{0,4}}{quote})(?<={NAMED}{quote})" for quote in ('"', "'", ""))
    return (rf"(?<=\")(?:{double}[^\"\r\n]{{{min_value},}}(?=\"))|(?<=')(?:{single}[^'\r\n]{{{min_value},}}(?='))"
            rf"|(?<=[=:> \t\"'])(?:{double}|{single}|{bare})[^\s\"']\S{{{min_value - 2},}}(?<![.,;)\]}}\"'])")


def findings(docs: DataFrame, min_chars: int = 16, min_value: int = 6) -> DataFrame:
    """``doc_id, source, nth, candidate, before, after``: every candidate with the text around it."""
    token = rf"{_value(min_value)}|(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{min_chars},}}(?![A-Za-z0-9_+/-])"
    # One pass of the pattern marks candidates; a split at the marks gives text and candidates in turn. A text that holds the mark itself is
    # taken apart by two passes.
    text, n = F.col("text"), F.size("parts")
    marked = F.split(F.regexp_replace(text, f"(?:{token})", f"{MARK}$0{MARK}"), MARK, -1)
    twice = F.flatten(F.zip_with(F.split(text, token, -1), F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda plain, found: F.array_compact(F.array(plain, found))))
    parts = docs.select("doc_id", "source", F.when(text.contains(MARK), twice).otherwise(marked).alias("parts"))
    # Neighbours are cut to size before rows are made, so no row carries the whole text. The outer form keeps the optimizer from testing
    # the array, and so the pattern, below the generator.
    each = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1, F.lit(2)), lambda i: F.struct(
        F.get("parts", i).alias("candidate"), F.right(F.get("parts", i - 1), F.lit(NEAR)).alias("before"), F.left(F.get("parts", i + 1), F.lit(NEAR)).alias("after"))))
    return parts.select("doc_id", "source", F.posexplode_outer(each).alias("nth", "f")).where("f IS NOT NULL").select("doc_id", "source", "nth", "f.candidate", "f.before", "f.after")


def dictionary(docs: DataFrame, share: float = 0.002) -> DataFrame:
    """``word, docs`` of the words of two letters or more that at least ``share`` of all rows hold."""
    n = docs.count()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).where(F.length("word") >= 2)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= max(1, share * n))


def _pieces(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def with_features(found: DataFrame, words: DataFrame, docs_per_source: DataFrame) -> DataFrame:
    """``found`` with :data:`FEATURES`. String features are computed once per distinct candidate."""
    low = F.lower("candidate")
    distinct = found.select("candidate").distinct()
    pairs = words.select(F.explode(_pieces(F.col("word"), 2)).alias("pair"), "docs").groupBy("pair").agg(F.sum("docs").alias("n"))
    chance = pairs.select("pair", F.log(F.col("n") / F.sum("n").over(Window.partitionBy(F.left("pair", F.lit(1))))).alias("chance"))
    triples = words.select(F.explode(_pieces(F.col("word"), 3)).alias("triple")).distinct().withColumn("known", F.lit(1.0))
    fluency = (distinct.select("candidate", F.explode(_pieces(low, 2)).alias("pair")).join(chance, "pair", "left")
               .groupBy("candidate").agg(F.avg(F.coalesce("chance", F.lit(-12.0))).alias("fluency")))
    coverage = (distinct.select("candidate", F.explode(_pieces(low, 3)).alias("triple")).join(triples, "triple", "left")
                .groupBy("candidate").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("coverage")))
    size = F.length("candidate").cast("double")
    share = lambda kind: F.length(F.regexp_replace("candidate", f"[^{kind}]", "")) / size
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
    shaped = (distinct.select("candidate", size.alias("length"), share("0-9").alias("digits"), share("A-Z").alias("uppers"), share("a-z").alias("lowers"),
                              ((F.length(kinds) - 1) / size).alias("turns"))
              .join(fluency, "candidate").join(coverage, "candidate"))
    rates = (found.groupBy("source").agg(F.count(F.lit(1)).alias("k")).join(docs_per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
             .select("s", (F.col("k") / F.col("n")).alias("path_rate")))
    flag = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    return (found.join(shaped, "candidate").join(rates, F.col("source").eqNullSafe(F.col("s"))).drop("s")
            .withColumns({"assigned": flag("before", r"[=:]\s*[\"']?$"), "quoted": flag("before", r"[\"']$"), "credential": flag("before", CREDENTIAL),
                          "closed": flag("after", r"^[\"']")}))


def judge(featured: DataFrame, labelled: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """``featured`` with ``probability`` and ``secret``. ``labelled`` is a part of it with a boolean ``label``."""
    labelled = labelled.where(F.col("label").isNotNull())
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        only = next(iter(counts), True)
        return featured.withColumns({"probability": F.lit(float(only)), "secret": F.lit(only)})
    steps = 1 << 30
    part = labelled.where(F.pmod(F.xxhash64(F.lit(13), "doc_id", "nth", "candidate"), F.lit(steps)) < min(steps, max_rows * steps // sum(counts.values())))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="target", featuresCol="features").fit(
        vectors.transform(materialise(part.withColumn("target", F.col("label").cast("double")), "labelled")))
    scored = fitted.transform(vectors.transform(featured)).withColumn("probability", F.element_at(vector_to_array("probability"), 2))
    return scored.withColumn("secret", F.col("probability") >= 0.5).drop("features", "rawPrediction", "prediction")


def scan(docs: DataFrame, label: Column, teaches: Column, **options) -> DataFrame:
    """Findings of ``docs`` with features, ``probability`` and ``secret``.

    ``label`` is a boolean expression over a finding (known format, analyst's verdict); ``teaches`` says which findings
    may be used for fitting.
    """
    docs = docs.select("doc_id", "text", "source")
    found = materialise(findings(docs), "findings")
    per_source = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    featured = materialise(with_features(found, dictionary(docs), per_source), "features")
    return judge(featured, featured.where(teaches).withColumn("label", label), **options)
