"""Line dedup by range-partitioned hashes, in DataFrame functions only.

Every document gives one row per distinct line key: two 64-bit hashes of the key and a bitmap of the
key's positions. Rows are range-partitioned by hash and sorted within partitions by hash and document, so
the first occurrences of a key stream past in order; a window of bounded width (``min_docs`` - 1 rows to
either side) tells whether the key is in ``min_docs`` documents without holding its group. Keys with more
than a thousandth of all rows (so fewer than a thousand keys) are found by a pre-aggregated count first,
broadcast and decided map-side, so no partition gets a hot key.

What comes back per document are keep bitmaps, stored as the 64-line words in which anything goes; texts
are not shuffled for the search.

Defined results: a document is its id and text, so rows repeated with the same id and text count as one
document and each gets the same result; null text and empty text are one empty line; a null id is an id
like any other; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BLANKS, LOWER, UPPER, ascii_lower, count_rows, cut, text_of

HOT_SHARE = 1000  # a key with more than this part of the rows is hot


def line_keys(lines: Column) -> Column:
    """What lines are compared by: both ends stripped of white space, A-Z lower-cased."""
    return F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS))))


def _rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, mark, h1, h2, at): a row for each distinct key of a document; at: the positions of its lines, ascending."""
    keyed = docs.select("doc", "mark", line_keys(F.split("text", "\n", -1)).alias("keys"))
    hashed = keyed.select(
        "doc",
        "mark",
        F.array_sort(
            F.transform(
                F.filter(F.transform("keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda x: F.char_length(x.k) >= min_chars),
                lambda x: F.struct(F.xxhash64(x.k).alias("h1"), F.xxhash64(F.lit(1), x.k).alias("h2"), x.i.alias("i")),
            )
        ).alias("all"),
    ).where(F.size("all") > 0)
    # Equal keys stand together now; a run of them begins where the hashes change.
    begun = hashed.withColumn(
        "starts",
        F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda j: (j == 0) | (F.get("all", j).h1 != F.get("all", j - 1).h1) | (F.get("all", j).h2 != F.get("all", j - 1).h2)),
    )
    runs = F.transform(
        "starts",
        lambda s, j: F.struct(
            F.get("all", s).h1.alias("h1"),
            F.get("all", s).h2.alias("h2"),
            F.transform(F.slice("all", s + 1, F.coalesce(F.get("starts", j + 1), F.size("all")) - s), lambda x: x.i).alias("at"),
        ),
    )
    return begun.select("doc", "mark", F.explode(runs).alias("run")).select("doc", "mark", "run.h1", "run.h2", "run.at")


def dropped_words(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc, mark, words): for each document that loses lines, [(word, bits)]; bit b of word w is line 64 w + b, set if it goes.

    docs: (doc, mark, text); mark tells texts of the same id apart. A key in at least ``min_docs`` documents
    and of at least ``min_chars`` code points loses its lines; with ``keep_first`` its first line, by
    document and position, stays.
    """
    rows = cut(_rows(docs, min_chars), "lines")
    by_key = ["h1", "h2"]
    total = count_rows(rows)
    hot = F.broadcast(cut(rows.groupBy(*by_key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total // HOT_SHARE).select(*by_key), "hot"))

    # Hot keys, fewer than HOT_SHARE: exact counts of documents, in partial sums.
    once = rows.join(hot, by_key, "left_semi").dropDuplicates([*by_key, "doc", "mark"])
    first = F.min(F.struct("doc", "mark"))
    verdicts = cut(once.groupBy(*by_key).agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where(F.col("n") >= min_docs), "verdicts")
    heavy = rows.join(F.broadcast(verdicts), by_key).select("doc", "mark", "at", (F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.mark") == F.col("mark"))).alias("is_first"))

    # The others: ordered by hash over the partitions, by document within a key.
    ranged = rows.join(hot, by_key, "left_anti").repartitionByRange(*by_key).sortWithinPartitions(*by_key, "doc", "mark")
    stream = Window.partitionBy(*by_key).orderBy("doc", "mark")
    again = F.coalesce(F.lag("doc").over(stream).eqNullSafe(F.col("doc")) & (F.lag("mark").over(stream) == F.col("mark")), F.lit(False))
    near = F.count(F.lit(1)).over(stream.rowsBetween(1 - min_docs, min_docs - 1))
    seen = ranged.withColumn("again", again).where("NOT again").withColumn("near", near).withColumn("place", F.row_number().over(stream))
    light = seen.where(F.col("near") >= min_docs).select("doc", "mark", "at", (F.col("place") == 1).alias("is_first"))

    gone = heavy.unionByName(light)
    at = F.when(F.col("is_first"), F.slice("at", 2, F.size("at"))).otherwise(F.col("at")) if keep_first else F.col("at")
    bits = gone.select("doc", "mark", F.explode(at).alias("pos")).groupBy("doc", "mark", F.expr("pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits"))
    return bits.groupBy("doc", "mark").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))


def without_lines(lines: Column, words: Column) -> Column:
    """The lines whose bits aren't set."""
    count = F.ceil(F.size(lines) / 64).cast("long")
    held = F.map_from_entries(words)
    dense = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda w: F.coalesce(F.try_element_at(held, w), F.lit(0).cast("long")))
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda w: F.slice(lines, (w * 64 + 1).cast("int"), F.lit(64)))
    return F.flatten(F.zip_with(dense, blocks, lambda b, block: F.filter(block, lambda _, i: F.call_function("shiftright", b, i).bitwiseAND(F.lit(1).cast("long")) == 0)))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (its other lines, joined), words (the bitmap, null: nothing goes)."""
    mine = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    gone = dropped_words(mine, min_docs, min_chars, keep_first).withColumnsRenamed({"doc": "_doc", "mark": "_mark"})
    both = mine.join(gone, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")), "left")
    lines = F.split("text", "\n", -1)
    return both.select(
        F.col("doc").alias("doc_id"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w.bits)), F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(without_lines(lines, F.col("words")), "\n")).alias("kept"),
        "words",
    )


SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (SELECT key FROM (SELECT DISTINCT doc_id, key FROM lines WHERE key <> '') GROUP BY key HAVING count(*) >= 10),
marked AS (SELECT lines.*, key IN (SELECT key FROM common) AS gone FROM lines)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
