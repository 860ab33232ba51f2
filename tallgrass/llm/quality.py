r"""Quality rules with adaptive thresholds (operator 8).

Fixed base rules come from the words of each text.  The cutoffs of three
further measures are not fixed: they follow from quantile sketches of the
corpus, one for each language and source.  A sketch is a histogram over
integers that keeps the seven leading bits of each value, so its size is
bounded, its relative error is below 1/64, and sketches merge by adding counts:
tasks build partial ones before the shuffle, and a source with fewer than
``MIN_GROUP`` texts uses its language's merged sketch, a rare language that of
the whole corpus.  A text is kept when no measure lies beyond its fence,
``FENCE`` times the spread between the quartiles away from them; spreads count
as at least ``LEAST_SPREAD``, so that uniform groups do not reject on trifles.

Measures, in thousandths: symbols per word, repeated lines per line, characters
per word.  Only DataFrame functions are used; measures are staged once and joined
with the thresholds of their group.

Rows: a null text has no words and fails the base rules, as does an empty one;
null languages and sources are a group of their own, together with empty ones;
repeated rows are judged each; an empty table gives an empty result; other
columns are not read.  Ties on a fence are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, importable, staged, text_of

SPACE = r"[\x20\x09-\x0D]"
FENCE, MIN_GROUP = 3, 50
#: measure: (least spread between quartiles, whether low values are rejected too)
MEASURES = {"symbol_rate": (30, False), "line_rate": (100, False), "word_size": (500, True)}


def base_measures(docs: DataFrame, keys: tuple[str, ...] = ("doc_id", "lang", "source"), window: int = 5) -> DataFrame:
    """``keys`` and the counts of each text."""
    importable(docs.sparkSession)
    rows = docs.select(*keys, text_of().alias("__text"))
    split = rows.select(*keys, "__text", F.array_remove(F.split("__text", SPACE + "+"), "").alias("__words"), F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    n = F.size("__words")
    at = F.when(n >= window, F.sequence(F.lit(1), n - window + 1)).otherwise(F.array().cast("array<int>"))
    counted = split.select(
        *keys,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.transform(at, lambda i: F.concat_ws(" ", F.slice("__words", i, window))).alias("__windows"),
    )
    names = [*keys, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    ordered = counted.select(*names, F.when(twice, F.sort_array(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))).alias("__sorted"))
    same = lambda s, other: F.coalesce(F.get("__sorted", other)["w"] == s["w"], F.lit(False))
    starts = ordered.select(*names, F.sort_array(F.transform(F.filter("__sorted", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"])).alias("__starts"))
    covered = F.transform("__starts", lambda s, k: F.least(F.lit(window), F.coalesce(F.get("__starts", k + 1) - s, F.lit(window))))
    return starts.select(*names, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def sketch_bucket(value: Column) -> Column:
    """The value with all but its seven leading bits cleared."""
    extra = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    unit = F.pow(F.lit(2.0), extra).cast("long")
    return value - value % unit


def rates(measured: DataFrame) -> DataFrame:
    """The adaptive measures, in thousandths; null without words."""
    per = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000 div {b}"))
    return measured.withColumns({"symbol_rate": per("n_symbols", "n_words"), "line_rate": per("n_dup_lines", "n_lines"), "word_size": per("word_chars", "n_words")})


def thresholds(rated: DataFrame) -> DataFrame:
    """(lang_key, source_key, low_*, high_* of each measure) for every group."""
    long = rated.select("lang_key", "source_key", F.expr("stack(3, " + ", ".join(f"'{m}', {m}" for m in MEASURES) + ") AS (measure, value)")).where("value IS NOT NULL")
    sketch = staged(long.groupBy("lang_key", "source_key", "measure", sketch_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "sketch")

    def quartiles(level: int, *keys: str) -> DataFrame:
        merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*keys, "measure").orderBy("bucket")
        whole = Window.partitionBy(*keys, "measure")
        ranked = merged.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
        first = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
        return ranked.groupBy(*keys, "measure").agg(F.max("total").alias(f"n{level}"), first(1).alias(f"q1_{level}"), first(3).alias(f"q3_{level}"))

    groups = sketch.select("lang_key", "source_key", "measure").distinct()
    found = groups.join(quartiles(0, "lang_key", "source_key"), ["lang_key", "source_key", "measure"]).join(quartiles(1, "lang_key"), ["lang_key", "measure"]).join(quartiles(2), ["measure"])
    pick = lambda q: F.when(F.col("n0") >= MIN_GROUP, F.col(f"{q}_0")).when(F.col("n1") >= MIN_GROUP, F.col(f"{q}_1")).otherwise(F.col(f"{q}_2"))
    found = found.select("lang_key", "source_key", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    columns = []
    for m, (least, both) in MEASURES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * FENCE
        of = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        columns.append(of(F.col("q3") + spread).alias(f"high_{m}"))
        if both:
            columns.append(of(F.col("q1") - spread).alias(f"low_{m}"))
    return found.groupBy("lang_key", "source_key").agg(*columns)


def judge(docs: DataFrame) -> DataFrame:
    """The counts of each row, whether it failed the base rules, and whether it stays."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{c}_key")
    measured = base_measures(docs).select("doc_id", key("lang"), key("source"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
    rated = rates(staged(measured, "measures"))
    joined = rated.join(thresholds(rated), ["lang_key", "source_key"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = ~failed
    for m, (_, both) in MEASURES.items():
        good &= F.coalesce(F.col(m) <= F.col(f"high_{m}"), F.lit(True))
        if both:
            good &= F.coalesce(F.col(m) >= F.col(f"low_{m}"), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), good.alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def _sql_thresholds() -> str:
    def picked(q: str) -> str:
        return f"CASE WHEN n0 >= {MIN_GROUP} THEN {q}_0 WHEN n1 >= {MIN_GROUP} THEN {q}_1 ELSE {q}_2 END"

    def level(k: int, keys: str) -> str:
        by, on = (keys + ", ", keys + ", ") if keys else ("", "")
        return f"""l{k} AS (SELECT {by}measure, max(total) AS n{k}, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1_{k},
  min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3_{k}
  FROM (SELECT *, sum(n) OVER (PARTITION BY {on}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {on}measure) AS total
        FROM (SELECT {by}measure, bucket, sum(n) AS n FROM sketch GROUP BY {by}measure, bucket)) GROUP BY {by}measure)"""

    cut = ", ".join(
        f"max(CASE WHEN measure = '{m}' THEN q3 + {FENCE} * greatest(q3 - q1, {least}) END) AS high_{m}" + (f", max(CASE WHEN measure = '{m}' THEN q1 - {FENCE} * greatest(q3 - q1, {least}) END) AS low_{m}" if both else "")
        for m, (least, both) in MEASURES.items()
    )
    return f"""{level(0, "lang_key, source_key")}, {level(1, "lang_key")}, {level(2, "")},
found AS (SELECT lang_key, source_key, measure, {picked("q1")} AS q1, {picked("q3")} AS q3
  FROM l0 JOIN l1 USING (lang_key, measure) JOIN l2 USING (measure)),
cut AS (SELECT lang_key, source_key, {cut} FROM found GROUP BY lang_key, source_key)"""


OP8_SQL = (
    r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang_key, coalesce(source, '') AS source_key, coalesce(text, '') AS s FROM documents),
w AS (SELECT *, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang_key, source_key, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
r AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END AS symbol_rate, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END AS line_rate,
  CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words END AS word_size FROM m),
v AS (SELECT lang_key, source_key, measure, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT lang_key, source_key, symbol_rate, line_rate, word_size FROM r) ON symbol_rate, line_rate, word_size INTO NAME measure VALUE value)),
sketch AS (SELECT lang_key, source_key, measure, value - value % CAST(pow(2, greatest(length(bin(value)) - 7, 0)) AS BIGINT) AS bucket, count(*) AS n FROM v GROUP BY ALL),
"""
    + _sql_thresholds()
    + """,
j AS (SELECT r.*, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, cut.* EXCLUDE (lang_key, source_key) FROM r LEFT JOIN cut USING (lang_key, source_key))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol_rate <= high_symbol_rate, true) AND coalesce(line_rate <= high_line_rate, true)
  AND coalesce(word_size <= high_word_size, true) AND coalesce(word_size >= low_word_size, true) AS kept
FROM j
"""
)
