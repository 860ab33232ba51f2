r"""Personal data and the terms that reveal it (operator 10).

Base kinds are found by patterns and checks (octets up to 255, Luhn, digit
counts).  The method then protects what the patterns cannot see: a term discloses a
protected value when knowing the term leaves little doubt about the
value.  With document frequencies over the whole corpus, for value c and term t,

    PMI(c; t) = log(P(c|t) / P(c)),  P(c|t) = (n(c,t) + PRIOR P(c)) / (n(t) + PRIOR),
    IC(c) = log(1 / P(c)),           P(c) = n(c) / N;

t discloses c when PMI(c; t) >= DISCLOSURE * IC(c).  Terms are words of four letters or
more; n(c,t) counts the documents that hold both, however far apart.  Values are
nearly unique, so no count of support is asked for: the prior draws rare pairs towards
independence but rules none out.  A value of all documents has no IC to disclose.
Every occurrence of a term in a document that holds a value it discloses is a span of
kind ``term``.  In ``sanitised`` texts base spans are generalised to their kind and
terms removed.

The condition bounds n(t) by n(c): the words of documents with values are joined with
n(t) first, and only terms rare enough for one of their document's values go on.  Where
a value occurs in one document, n(c,t) is 1 and no pair is made; pairs are made and
counted for values of several documents only.

Only DataFrame functions are used.  One pass stages each row's matches with the
lengths of the text between them, and the words of rows with matches; positions are
running sums over these.

Rows: null text counts as empty and has no spans; repeated rows are each
reported and each count in the frequencies; an empty table gives an empty
result; other columns are not read, and ``sanitised`` returns them unchanged, whatever
their names.  A very long text is cut into words like any other, in linear time.
Offsets are code points, end exclusive; of spans that start together the shorter is
told first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, fresh, importable, likely, located, scratch, staged, text_of

#: kind: (pattern, cheap test that a match needs).  Possessive forms match the
#: same strings as the plain ones; the look-behinds name places where no match
#: starts because one a character earlier would have been taken, so that a long
#: run is scanned once.
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
TERM = r"\p{L}{4,}"
DISCLOSURE = 0.9
#: The weight of P(c) in P(c|t), in documents (Jeffreys' for a yes or no).
PRIOR = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    octet = lambda x: F.length(F.regexp_replace(x, "^0+", "")) <= 3
    octets = F.forall(F.split(value, r"\."), lambda x: octet(x) & (F.substring(F.concat(F.lit("000"), x), -3, 3).cast("int") <= 255))
    card = F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", octets).when(kind == "card", card).otherwise(n.between(9, 15))


def found(rows: DataFrame) -> DataFrame:
    """Staged: for each of ``rows`` (..., text) a number ``at``, the other columns, its
    unchecked matches and its words.

    A hit has its kind, number within the kind, the length of the text since the previous
    one of its kind, and its value; ``words`` has each word of a row with matches and
    the length of the text since the previous one, else it is null.
    """
    others = [c for c in rows.columns if c != "text"]
    text = F.col("text")
    split = rows.select("*", *(F.when(text.rlike(test), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"{k}_hits") for k, (p, test) in KINDS.items()), *(F.when(text.rlike(test), F.split("text", p, -1)).alias(f"{k}_gaps") for k, (p, test) in KINDS.items()))

    def hits(k: str) -> Column:
        each = F.transform(f"{k}_hits", lambda v, i: F.struct(F.lit(k).alias("kind"), i.alias("nth"), F.length(F.get(f"{k}_gaps", i)).alias("gap"), v.alias("value")))
        return F.coalesce(each, F.array().cast("array<struct<kind:string,nth:int,gap:int,value:string>>"))

    all_hits = split.select(F.monotonically_increasing_id().alias("at"), *others, "text", F.concat(*(hits(k) for k in KINDS)).alias("hits"))
    # two steps, so that only rows with matches are cut into words
    word = F.arrays_zip(F.transform(F.split("text", TERM, -1), F.length).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("word"))
    return staged(all_hits.withColumn("words", F.when(F.size("hits") > 0, word)).drop("text"), "hits")


def base_spans(hits: DataFrame) -> DataFrame:
    """(at, kind, start, end, value, entity) of the valid matches."""
    each = hits.select("at", F.explode("hits").alias("h")).select("at", "h.*")
    upto = Window.partitionBy("at", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("value")).over(upto)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    entity = F.concat(F.col("kind"), F.lit(":"), F.when(F.col("kind").isin("card", "phone"), _digits(F.col("value"))).otherwise(F.lower("value")))
    return placed.where(_valid(F.col("kind"), F.col("value"))).select("at", "kind", "start", "end", "value", entity.alias("entity"))


def disclosing(docs: DataFrame, hits: DataFrame, spans: DataFrame, n_docs: int) -> DataFrame:
    """Staged: (at, term) of the terms that disclose a value of their document."""
    held = spans.select("at", "entity").distinct()
    of_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") < n_docs)
    held = staged(held.join(of_entity, "entity"), "values")
    p_c = F.col("n_c") / F.lit(max(n_docs, 1))
    rarity = F.pow(p_c, F.lit(1 - DISCLOSURE))
    # as n(c,t) is n(c) at most; a little more, for the rounding
    limits = held.groupBy("at").agg(F.max((F.col("n_c") + PRIOR * p_c) / rarity * (1 + 1e-9)).alias("limit"), F.min("n_c").alias("least"))
    words = hits.join(limits, "at").select("at", "limit", "least", F.explode(F.array_distinct(F.transform("words", lambda w: F.lower(w["word"])))).alias("term")).where("term IS NOT NULL")
    all_words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text_of(), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    of_term = all_words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    rare = staged(words.join(of_term, "term").where(F.col("n_t") + PRIOR <= F.col("limit")), "rare")
    reached = lambda n_ct: n_ct + PRIOR * p_c >= (F.col("n_t") + PRIOR) * rarity
    alone = rare.where("least = 1").withColumn("n_c", F.lit(1)).where(reached(F.lit(1))).select("at", "term")
    pairs = rare.select("at", "term", "n_t").join(held.where("n_c > 1"), "at")
    risky = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct")).where(reached(F.col("n_ct"))).select("entity", "term")
    return staged(alone.union(pairs.join(risky, ["entity", "term"]).select("at", "term")).distinct(), "disclosing")


def all_spans(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The staged matches of ``rows`` (see :func:`found`), which are ``docs``; (at, kind, start, end) of base and term spans."""
    hits = found(rows)
    spans = staged(base_spans(hits), "spans")
    revealing = disclosing(docs, hits, spans, hits.count())
    each = hits.join(revealing.select("at").distinct(), "at", "left_semi").select("at", F.posexplode("words").alias("i", "w")).select("at", "i", "w.*").where("word IS NOT NULL")
    end = F.sum(F.col("gap") + F.length("word")).over(Window.partitionBy("at").orderBy("i"))
    places = each.select("at", F.lower("word").alias("term"), (end - F.length("word")).alias("start"), end.alias("end"))
    terms = places.join(revealing, ["at", "term"]).select("at", F.lit("term").alias("kind"), "start", "end")
    return hits, spans.select("at", "kind", "start", "end").unionByName(terms)


def _joined(kinds: list[str]) -> Column:
    """kind:start:end in order, of the collected spans."""
    order = F.sort_array("all")
    own = F.filter(order, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """Staged: counts, digest of the base spans and all spans, for each row."""
    importable(docs.sparkSession)
    with scratch(docs.sparkSession):
        hits, spans = all_spans(docs, docs.select("doc_id", text_of().alias("text")))
        kinds = [*KINDS, "term"]
        place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
        by_row = spans.groupBy("at").agg(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind")).alias("all"))
        rows = hits.select("at", "doc_id").join(by_row, "at", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<place:int,start:bigint,end:bigint,kind:string>>")))
        count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
        return staged(rows.select("doc_id", *map(count, KINDS), F.sha2(_joined(list(KINDS)).cast("binary"), 256).alias("base_sha256"), _joined(kinds).alias("spans")), "personal-data", last=True)


def cuts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Staged: (file, row, cuts) of the rows with spans; overlapping spans become one,
    named after the first base span."""
    with scratch(docs.sparkSession):
        hits, spans = all_spans(docs, rows)
        ordered = Window.partitionBy("at").orderBy("start", "end", "kind")
        reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        runs = spans.withColumn("run", F.sum(F.when(F.coalesce(reach, F.lit(-1)) <= F.col("start"), 1).otherwise(0)).over(ordered))
        merged = runs.groupBy("at", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct(F.col("kind") == "term", "start", "end", "kind")).alias("kind"))
        by_row = merged.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
        return staged(hits.select("at", "file", "row").join(by_row, "at").drop("at"), "cuts", last=True)


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans as <KIND>, disclosing terms removed, n_chars set anew.

    Only texts with spans are shuffled to their cuts, as far as a bitmap tells them apart.
    """
    names = docs.columns
    path, row, cut, may = (fresh(docs, c) for c in ("path", "row", "cuts", "may"))
    rows = located(docs, ["*"], path, row)
    file = F.xxhash64(path)
    of_row = cuts(rows, rows.select(text_of().alias("text"), file.alias("file"), F.col(row).alias("row"))).select(F.col("file").alias(f"{path}_file"), F.col("row").alias(f"{row}_row"), F.col("cuts").alias(cut))
    keys = of_row.select(F.col(f"{path}_file").alias(f"{path}_hash"), F.col(f"{row}_row").alias(row))
    marked = likely(rows.withColumn(f"{path}_hash", file), [f"{path}_hash", row], keys, may)
    joined = marked.where(may).join(of_row, (F.col(f"{path}_hash") == F.col(f"{path}_file")) & (F.col(row) == F.col(f"{row}_row")), "left")
    mark = lambda k: F.when(k == "term", "").otherwise(F.concat(F.lit("<"), F.upper(k), F.lit(">")))
    piece = lambda c, i: F.concat(F.substring("text", F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)).cast("int") + 1, (c["start"] - F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))).cast("int")), mark(c["kind"]))
    last = F.element_at(cut, -1)["end"].cast("int")
    clean = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform(cut, piece), ""), F.substring(F.col("text"), last + 1, F.length("text"))))
    out = joined.withColumn("text", clean)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names).unionByName(marked.where(~F.col(may)).select(*names))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))


_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sql() -> str:
    raw = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS kind, {i} AS place, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS gaps FROM d" for i, (k, p) in enumerate(_SQL_PATTERNS.items(), 1))
    total = lambda a, n: f"coalesce(list_sum(list_transform(({a})[1:{n}], lambda x: length(x))), 0)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
e AS (SELECT *, unnest(hits) AS v, unnest(range(1, len(hits) + 1)) AS i FROM raw),
p AS (SELECT doc_id, t, kind, place, v, regexp_replace(v, '[^0-9]', '', 'g') AS n,
  CAST({total("gaps", "i")} + {total("hits", "i - 1")} AS BIGINT) AS s FROM e),
s AS (SELECT *, s + length(v) AS f, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN n ELSE lower(v) END AS entity FROM p
  WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: TRY_CAST(x AS HUGEINT) <= 255))
    WHEN 'card' THEN length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda k: CASE WHEN (length(n) - k) % 2 = 0 THEN CAST(n[k] AS INT)
      ELSE CAST(n[k] AS INT) * 2 - CASE WHEN CAST(n[k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(n) BETWEEN 9 AND 15 END),
held AS (SELECT DISTINCT doc_id, entity FROM s),
w AS (SELECT doc_id, regexp_extract_all(t, '\p{{L}}{{4,}}') AS words, string_split_regex(t, '\p{{L}}{{4,}}') AS gaps FROM d WHERE doc_id IN (SELECT doc_id FROM s)),
x AS (SELECT doc_id, unnest(words) AS v, unnest(gaps[1:len(words)]) AS g, unnest(range(1, len(words) + 1)) AS i FROM w),
term AS (SELECT doc_id, lower(v) AS term, CAST(sum(length(g) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(v) AS s, length(v) AS n FROM x),
own AS (SELECT DISTINCT doc_id, term FROM term),
ct AS (SELECT entity, term, count(*) AS n_ct FROM held JOIN own USING (doc_id) GROUP BY ALL),
nc AS (SELECT entity, count(*) AS n_c, count(*) / (SELECT count(*) FROM d) AS p_c FROM held GROUP BY ALL HAVING count(*) < (SELECT count(*) FROM d)),
nt AS (SELECT term, count(DISTINCT doc_id) AS n_t FROM (SELECT doc_id, lower(unnest(regexp_extract_all(t, '\p{{L}}{{4,}}'))) AS term FROM d) GROUP BY ALL),
risky AS (SELECT entity, term FROM ct JOIN nc USING (entity) JOIN nt USING (term) WHERE n_ct + {PRIOR} * p_c >= (n_t + {PRIOR}) * pow(p_c, {1 - DISCLOSURE!r})),
here AS (SELECT DISTINCT doc_id, term FROM held JOIN own USING (doc_id) JOIN risky USING (entity, term)),
spans AS (SELECT doc_id, kind, place, s, f FROM s UNION ALL SELECT doc_id, 'term', 5, s, s + n FROM term JOIN here USING (doc_id, term)),
o AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || f, ',' ORDER BY place, s) FILTER (place < 5) AS base, string_agg(kind || ':' || s || ':' || f, ',' ORDER BY place, s, f) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card,
  CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN o USING (doc_id)
"""


OP10_SQL = _sql()
