"""Rule-based quality by cross-document line frequency, in DataFrame functions alone.

Each text is split at newlines; a line is normalised (lower-cased, runs of blanks made one space, trimmed) and
hashed. Per host, the distinct documents that hold a line are counted. Copies must not turn a text into boilerplate, so
documents are told apart by a digest of all their distinct lines: however many rows have the same lines, they count once.
Lines that over ``max_docs`` such documents hold are removed; a document of which fewer than ``min_words`` words or less
than ``min_share`` of the words stay is depleted and rejected.

Defined cases: a null or empty text has no words, lines or symbols and fails the base rules; a null host is a host of
its own; repeated rows are each judged and get equal verdicts, and count as one document, as do documents with the same set of
lines; extra columns pass through ``clean`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import table, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Frequent lines are broadcast up to this count (48 bytes each at most), and joined by shuffle beyond it.
BROADCAST_LINES = 50_000


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the base counts of each row added."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    keep = [c for c in docs.columns if c != text]
    step = docs.select(
        *keep,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_qr_w"),
        F.char_length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
    )
    at = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    # bound to a variable: else a filter pushed down to here would split the text anew for every window
    windows = F.expr(f"transform(array(_qr_w), w -> if(size(w) < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({at}))))[0]")
    step = step.select(*keep, "word_chars", "n_symbols", "n_dup_lines", F.size("_qr_w").cast("long").alias("n_words"), windows.alias("_qr_h"))
    # windows sorted by hash; those equal to a neighbour repeat; the words they cover, counted from left to right
    repeated = F.expr(f"""
        transform(array(_qr_h), hs -> if(size(array_distinct(hs)) = size(hs), 0L,
           aggregate(
             transform(array(sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))), s ->
               sort_array(transform(filter(transform(s, (x, k) -> named_struct('i', x.i, 'r',
                   (get(s, k - 1).h <=> x.h) or (get(s, k + 1).h <=> x.h))), y -> y.r), y -> y.i)))[0],
             named_struct('n', 0L, 'last', -{WINDOW}),
             (a, v) -> named_struct('n', a.n + least({WINDOW}, v - a.last), 'last', v),
             a -> a.n)))[0]""")
    return step.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[ \t\x0B\f\r]+", " ")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" "))


def _line_id(line: Column) -> Column:
    return F.substring(F.md5(line.cast("binary")), 1, 16)


def lines(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """One row per line with a word: its document, host, hash, words, whether it is the line's first place in the document, and
    the digest of the document's distinct lines. Sorting each document's hashes finds the first places."""
    normal = F.filter(F.transform(F.split(_normal(F.coalesce(F.col(text), F.lit(""))), "\n"), _trimmed), lambda x: x != "")
    hashed = F.sort_array(F.transform(normal, lambda x: F.struct(_line_id(x).alias("id"), F.size(F.split(x, " ")).cast("long").alias("n"))))
    # bound to one variable each, so that neither is worked out again for every element
    first = F.transform(F.array(hashed), lambda s: F.transform(s, lambda x, i: F.struct(x["id"].alias("id"), x["n"].alias("n"), (~F.get(s, i - 1)["id"].eqNullSafe(x["id"])).alias("first"))))[0]
    digest = lambda s: F.xxhash64(F.transform(F.filter(s, lambda x: x["first"]), lambda x: x["id"]))
    both = F.transform(F.array(first), lambda s: F.struct(s.alias("lines"), digest(s).alias("digest")))[0]
    rows = docs.select(F.col(key).alias("_qr_key"), F.xxhash64(host, text).alias("_qr_hash"), F.col(host).alias("_qr_host"), both.alias("_qr_s"))
    rows = rows.select("_qr_key", "_qr_hash", "_qr_host", F.col("_qr_s.digest").alias("_qr_digest"), F.col("_qr_s.lines").alias("_qr_l"))
    # the outer form, as the plain one adds a filter that works the array out again
    one = rows.select("_qr_key", "_qr_hash", "_qr_host", "_qr_digest", F.inline_outer("_qr_l")).filter("id is not null")
    return one.select("_qr_key", "_qr_hash", "_qr_host", "_qr_digest", F.col("id").alias("_qr_id"), F.col("n").alias("_qr_n"), F.col("first").alias("_qr_first"))


def frequent_lines(rows: DataFrame, max_docs: int = 20) -> DataFrame:
    """(host, id) of the lines that over ``max_docs`` distinct documents of the host hold."""
    documents = rows.filter("_qr_first").select("_qr_host", "_qr_id", "_qr_digest").distinct()
    return documents.groupBy("_qr_host", "_qr_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_docs).select("_qr_host", "_qr_id")


def _flagged(docs: DataFrame, key: str, host: str, text: str, max_docs: int) -> DataFrame:
    """Per document that holds frequent lines: their hashes and the number of their words.

    A document is known by its key and a hash of its host and text, so repeated keys are told apart. The lines are
    written once, about 40 bytes each, and read for the counts and for the join."""
    rows = written(lines(docs, key, host, text), "lines")
    common = written(frequent_lines(rows, max_docs), "frequent-lines").alias("f")
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    hit = rows.alias("l").join(common, (F.col("l._qr_id") == F.col("f._qr_id")) & F.col("l._qr_host").eqNullSafe(F.col("f._qr_host")))
    # rows repeated as a whole add up here: each copy has one first place of the line
    per_line = hit.groupBy("_qr_key", "_qr_hash", "l._qr_id").agg((F.sum("_qr_n") / F.count_if("_qr_first")).cast("long").alias("_qr_n"))
    return per_line.groupBy("_qr_key", "_qr_hash").agg(F.sum("_qr_n").alias("_qr_removed"), F.collect_set("_qr_id").alias("_qr_ids"))


def _verdict(min_words: int, min_share: float) -> Column:
    left = F.col("n_words") - F.col("n_removed_words")
    return ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words"))


def judge(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = 20, min_words: int = 10, min_share: float = 0.1) -> DataFrame:
    """One row per document: key, the base counts, words in frequent lines, ``base_failed`` and ``kept``."""
    flagged = _flagged(docs, key, host, text, max_docs).drop("_qr_ids")
    rows = docs.select(F.col(key).alias("_qr_k"), F.xxhash64(host, text).alias("_qr_h2"), F.col(text).alias("_qr_text"))
    rows = features(rows, "_qr_text").withColumn("base_failed", base_failed())
    found = rows.join(flagged, F.col("_qr_k").eqNullSafe(F.col("_qr_key")) & (F.col("_qr_h2") == F.col("_qr_hash")), "left")
    found = found.withColumn("n_removed_words", F.coalesce("_qr_removed", F.lit(0)).cast("long"))
    return found.select(F.col("_qr_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", _verdict(min_words, min_share).alias("kept"), "n_removed_words")


def clean(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", max_docs: int = 20, min_words: int = 10, min_share: float = 0.1) -> DataFrame:
    """The kept documents with all their columns, frequent lines taken out of the text.

    A text without frequent lines stays as it is to the byte."""
    flagged = _flagged(docs, key, host, text, max_docs)
    # the document travels as one struct, so its names meet none of these
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_qr_doc"), F.col(key).alias("_qr_k"), F.xxhash64(host, text).alias("_qr_h2"), F.col(text).alias("_qr_text"))
    rows = features(rows, "_qr_text")
    # the row number keeps the filters above it, where each count has been worked out once
    rows = rows.withColumn("_qr_row", F.monotonically_increasing_id()).withColumn("base_failed", base_failed()).filter("_qr_row >= 0 and not base_failed")
    found = rows.join(flagged, F.col("_qr_k").eqNullSafe(F.col("_qr_key")) & (F.col("_qr_h2") == F.col("_qr_hash")), "left")
    found = found.withColumn("n_removed_words", F.coalesce("_qr_removed", F.lit(0)).cast("long")).filter(_verdict(min_words, min_share))
    whole = F.col("_qr_doc")[text]
    left = F.array_join(F.filter(F.split(whole, "\n"), lambda x: ~F.array_contains("_qr_ids", _line_id(_trimmed(_normal(x))))), "\n")
    return found.select(*[(F.when(F.col("_qr_ids").isNull(), whole).otherwise(left) if c == text else F.col("_qr_doc")[c]).alias(c) for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
          SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, source, s, substr(md5(s), 1, 16) AS id, len(string_split(s, ' ')) AS n FROM (
         SELECT doc_id, source, trim(regexp_replace(lower(x), '[ \t\x0B\f\r]+', ' ', 'g'), ' ') AS s
         FROM (SELECT doc_id, source, unnest(ls) AS x FROM w)) WHERE s <> ''),
per AS (SELECT doc_id, source, id, sum(n) AS n FROM ln GROUP BY ALL),
dig AS (SELECT doc_id, md5(string_agg(id, '' ORDER BY id)) AS digest FROM per GROUP BY doc_id),
freq AS (SELECT source, id FROM per JOIN dig USING (doc_id) GROUP BY ALL HAVING count(DISTINCT digest) > 20),
gone AS (SELECT doc_id, sum(n) AS n FROM per JOIN freq ON per.id = freq.id AND per.source IS NOT DISTINCT FROM freq.source GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words - n_removed_words >= 10 AND n_words - n_removed_words >= 0.1 * n_words) AS kept, n_removed_words
FROM v
"""
