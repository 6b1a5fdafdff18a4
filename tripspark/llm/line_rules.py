"""Quality rules with cross-document line frequency, in Spark expressions only.

Normalised lines are hashed; for each host the distinct texts that hold a line are counted over all documents;
lines at the limit, which does not grow with the host, are template text and are removed; documents that keep too little are rejected. Copies of
one text count once, so a group of copies is left to the duplicate stage and not taken for a template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import SPACES, join_sized

MIN_WORDS = 50
REPEAT_PERCENT = 50  # of the words, in repeated 3-word windows
LINE_MIN_DOCS = 10  # a template line stands in at least so many distinct texts of its host, however large the host
KEPT_SHARE = 0.7  # a document that keeps less than this share of its words is rejected

# Windows are compared by the high bits of a 64-bit hash; the low bits, as many as the text needs, hold the place.
# The words are a lambda's argument, so no optimizer rule can put their splitting into the loop over windows.
_MEASURED = """
transform(array(words), w -> transform(array(CAST(pow(2, ceil(log2(greatest(size(w), 2)))) AS BIGINT) - 1L), low -> named_struct(
  'n', CAST(size(w) AS BIGINT),
  'chars', CAST(length(array_join(w, '')) AS BIGINT),
  'repeated', CASE WHEN size(w) < 3 THEN 0L ELSE
    transform(array(array_sort(transform(sequence(0, size(w) - 3), i ->
        (xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)) & ~low) | CAST(i AS BIGINT)))),
      s -> aggregate(
        array_sort(transform(
          filter(s, (x, j) -> ((x ^ get(s, j - 1)) & ~low) = 0 OR ((x ^ get(s, j + 1)) & ~low) = 0),
          x -> x & low)),
        named_struct('total', 0L, 'last', -3L),
        (a, x) -> named_struct('total', a.total + least(3L, x - a.last), 'last', x),
        a -> a.total))[0] END))[0])[0]"""


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __rule, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    cut = f"array_remove(split(coalesce(`{text}`, ''), '{SPACES}'), '')".replace("\\", "\\\\")
    got = docs.withColumn("__m", F.expr(_MEASURED.replace("array(words)", f"array({cut})")))
    n, repeated = F.col("__m.n"), F.col("__m.repeated")
    rule = F.struct(
        n.alias("n_words"),
        F.col("__m.chars").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n)).alias("base_failed"),
    )
    return got.withColumn("__rule", rule).drop("__m")


def line_table(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """(id, sig, host, at, line, n): one row for each line with a word; ``sig`` is the hash of the whole text."""
    # every kind of white space but the line feed becomes one space; n counts the words of the line
    flat = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    cut = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text)).alias("sig"),
        F.xxhash64(F.coalesce(F.col(host).cast("string"), F.lit(""))).alias("host"),
        F.posexplode(lines).alias("at", "__line"),
    ).filter("__line <> ''")
    n = F.length("__line") - F.length(F.replace("__line", F.lit(" "), F.lit(""))) + 1
    return cut.select("id", "sig", "host", "at", F.xxhash64("__line").alias("line"), n.alias("n"))


def template_lines(lines: DataFrame) -> DataFrame:
    """(host, line, n_texts) of lines at the limit; counts cover every document."""
    held = lines.select("host", "line", "sig").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_texts"))
    return held.filter(F.col("n_texts") >= LINE_MIN_DOCS)


def verdicts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``docs`` with __rule (see `base_measures`), __removed (words in template lines) and __kept.

    Null text counts as empty and fails the base rules; a null host is a host of its own; rows with equal id and
    text get equal results and stay separate rows; a null id is an id. Other columns pass through.
    """
    lines = line_table(docs, id_col, text, host)
    hit = join_sized(lines, template_lines(lines).select("host", "line"), ["host", "line"], "inner")
    gone = hit.dropDuplicates(["id", "sig", "at"]).groupBy("id", "sig").agg(F.sum("n").cast("long").alias("__gone"))
    gone = gone.select(F.col("id").alias("__id"), F.col("sig").alias("__sig"), "__gone")
    based = base_measures(docs, text)
    same = based[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(based[text]) == F.col("__sig"))
    joined = join_sized(based, gone, same, "left")
    removed = F.coalesce("__gone", F.lit(0).cast("long"))
    n = F.col("__rule.n_words")
    # one expression over both sides: a filter on it stays above the join, where the rules are columns already
    kept = F.when(F.col("__rule.base_failed"), False).otherwise(n - removed >= KEPT_SHARE * n)
    return joined.withColumns({"__removed": removed, "__kept": kept}).drop("__id", "__sig", "__gone")


def clean_text(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(id, text) of every document with its template lines taken out, the others as they were, in order."""
    lines = line_table(docs, id_col, text, host)
    hit = join_sized(lines, template_lines(lines).select("host", "line"), ["host", "line"], "inner")
    gone = hit.groupBy("id", "sig").agg(F.collect_set("line").alias("__set"))
    gone = gone.select(F.col("id").alias("__id"), F.col("sig").alias("__sig"), "__set")
    same = docs[id_col].eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__sig"))
    joined = docs.join(gone, same, "left")
    norm = f"xxhash64(trim(lower(regexp_replace(x, '[\\\\x20\\\\x09\\\\x0B-\\\\x0D]+', ' '))))"
    rest = F.expr(f"array_join(filter(split(`{text}`, '\\n'), x -> NOT array_contains(__set, {norm})), '\\n')")
    return joined.select(F.col(id_col), F.when(F.col("__set").isNull(), F.col(text)).otherwise(rest).alias(text))


def op3_line_rules(docs: DataFrame) -> DataFrame:
    """Contract columns of the rules, one row per document."""
    got = verdicts(docs.select("doc_id", "text", "source"))
    return got.select("doc_id", "__rule.*", F.col("__kept").alias("kept"), F.col("__removed").alias("n_removed_words"))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM dup, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY rid),
ln AS (SELECT rid, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
lw AS (SELECT rid, source, text, raw,
         trim(lower(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' ') AS line
       FROM ln WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
dl AS (SELECT rid, count(*) - count(DISTINCT raw) AS n FROM lw GROUP BY rid),
held AS (SELECT source, line, count(DISTINCT text) AS n FROM lw GROUP BY source, line),
tpl AS (SELECT source, line FROM held WHERE n >= {LINE_MIN_DOCS}),
gone AS (SELECT lw.rid, sum(length(lw.line) - length(replace(lw.line, ' ', '')) + 1)::BIGINT AS n
         FROM lw JOIN tpl ON lw.source = tpl.source AND lw.line = tpl.line GROUP BY lw.rid),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w ON d.rid = w.rid LEFT JOIN dl ON d.rid = dl.rid LEFT JOIN rep ON d.rid = rep.rid
  LEFT JOIN gone ON d.rid = gone.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
        AND n_words - n_removed_words >= {KEPT_SHARE}::DOUBLE * n_words) AS kept,
       n_removed_words
FROM m
"""
