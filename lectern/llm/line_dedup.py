"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Tables, fresh

MIN_LINES = 3
MIN_WORDS = 50


def split_lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def numbered(tables: Tables, groups: DataFrame, by: list[str], name: str) -> DataFrame:
    """The groups with a number that rises in the order of `by`: written after a range-partitioned sort, so that a number is stable."""
    return tables.put(name, groups.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()))


def tied_suffixes(tables: Tables, documents: DataFrame, depth: int) -> DataFrame:
    """(d, h, i, rank): each position whose next `depth` lines also occur elsewhere, rank being the number of its interval
    among the sorted suffixes (suffixes with a common prefix of `depth` lines at least). documents: (d, h, text).

    Prefix doubling: ranks by k lines, joined with themselves k positions on, give ranks by 2k lines. A position whose rank is its own
    alone has no longer repeat and leaves; so a round costs what is still tied. The order of lines is that of their hashes (two of 64
    bits). Blank lines have no rank, so no repeat runs over them."""
    line = F.posexplode(split_lines("text")).alias("i", "line")
    lines = documents.select("d", "h", line).where(F.col("line").rlike(r"\S")).select("d", "h", "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))
    groups = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    ranks = numbered(tables, groups.select("a", "b"), ["a", "b"], "ranks")
    now = tables.put("tied", lines.join(ranks, ["a", "b"]).select("d", "h", "i", "rank"))
    reached = 1
    while reached < depth:
        step = min(reached, depth - reached)
        after = now.select("d", "h", (F.col("i") - step).alias("i"), F.col("rank").alias("b"))
        pairs = tables.put("pairs", now.withColumnRenamed("rank", "a").join(after, ["d", "h", "i"]))
        groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
        ranks = numbered(tables, groups.select("a", "b"), ["a", "b"], "ranks")
        now = tables.put("tied", pairs.join(ranks, ["a", "b"]).select("d", "h", "i", "rank"))
        reached += step
    return now


def repeated_runs(documents: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, start, stop): the maximal runs of lines that are later copies. A position is a later copy if its next `min_lines`
    lines also start earlier: in a smaller id, or earlier in the same document. Runs that touch or overlap are one.
    d is the id and h the hash of the text: rows with the same id and text are one document; null ids or texts have no runs."""
    tables = Tables(documents.sparkSession, "lines")
    source = documents.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("d is not null and text is not null")
    doubled = source.groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if doubled:
        source = source.dropDuplicates(["d", "h"])
    tied = tied_suffixes(tables, source, min_lines)
    # of each interval of the suffix array all but its first position; met by position, not by interval, as one interval may be very large
    first = tied.groupBy("rank").agg(F.min(F.struct("d", "h", "i")).alias("first")).select("first.*").hint("merge")
    later = tied.select("d", "h", "i").join(first, ["d", "h", "i"], "left_anti")
    order = Window.partitionBy("d", "h").orderBy("i")
    begins = F.coalesce((F.col("i") > F.lag("i").over(order) + min_lines).cast("int"), F.lit(1))
    runs = later.withColumn("run", begins).withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = tables.put("runs", runs.groupBy("d", "h", "run").agg(F.min("i").alias("start"), (F.max("i") + min_lines).alias("stop")).drop("run"))
    tables.drop("ranks", "tied", "pairs")
    return out


def repeated_passages(documents: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, start, stop): the maximal runs of lines that are later copies, a run counting if it has `min_lines` lines or `min_words`
    words (runs of non-space characters), so that one or two long lines count, too. d, h and odd rows are as in repeated_runs.
    Blank lines play no part in a run, so paragraphs parted by them are one run; those between two deleted lines go with them.

    A longer run that counts is the union of windows of at most `min_lines` lines that count: each line of it is in one that starts or
    ends with it or holds it, and all of them occur earlier where the run does. So ranks by 1, 2, ... `min_lines` lines, each made
    from those by one line less, find every line that deeper ranks would."""
    tables = Tables(documents.sparkSession, "passages")
    source = documents.select(F.col(id_col).alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).where("d is not null and text is not null")
    if source.groupBy("d", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        source = source.dropDuplicates(["d", "h"])
    at = F.transform(split_lines("text"), lambda x, i: F.struct(x.alias("line"), i.alias("p")))
    lines = source.select("d", "h", F.posexplode(F.filter(at, lambda x: x["line"].rlike(r"\S"))).alias("i", "at")).select("d", "h", "i", "at.p", "at.line")
    lines = lines.select("d", "h", "i", "p", F.size(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0))).cast("long").alias("words"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), F.col("p").alias("end"))
    found = None
    for depth in range(1, min_lines + 1):
        groups = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "i")).alias("first")).where("n > 1")
        ranks = tables.put("ranks", groups.orderBy("a", "b").select("a", "b", "first").withColumn("rank", F.monotonically_increasing_id()))
        now = tables.put("tied", lines.join(ranks, ["a", "b"]).select("d", "h", "i", "p", "end", "words", "rank", (F.struct("d", "h", "i") != F.col("first")).alias("later")))
        counts = F.col("later") if depth == min_lines else F.col("later") & (F.col("words") >= min_words)
        here = now.where(counts).select("d", "h", "i", "p", (F.col("i") + depth).alias("stop"), "end")
        found = here if found is None else found.unionByName(here)
        if depth < min_lines:
            after = now.select("d", "h", (F.col("i") - 1).alias("i"), F.col("rank").alias("b"))
            if depth == 1:
                single = tables.put("single", now.select("d", "h", "i", F.col("words").alias("one"), "end"))
            last = single.select("d", "h", (F.col("i") - depth).alias("i"), "one", "end")
            lines = tables.put("pairs", now.select("d", "h", "i", "p", "words", F.col("rank").alias("a")).join(after, ["d", "h", "i"]).join(last, ["d", "h", "i"]).select("d", "h", "i", "p", "end", (F.col("words") + F.col("one")).alias("words"), "a", "b"))
    found = found.groupBy("d", "h", "i", "p").agg(F.max("stop").alias("stop"), F.max("end").alias("end"))
    order = Window.partitionBy("d", "h").orderBy("i")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("run", F.coalesce((F.col("i") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("run").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = tables.put("runs", runs.groupBy("d", "h", "run").agg(F.min("p").alias("start"), (F.max("end") + 1).alias("stop")).drop("run"))
    tables.drop("ranks", "tied", "pairs", "single")
    return out


def with_runs(documents: DataFrame, min_lines: int, id_col: str, text_col: str, min_words: int | None = None) -> tuple[DataFrame, Column, Column, Column]:
    """The documents with a column of runs, that column, the column of their lines and that of the lines kept. Internal names differ from all
    of the documents' columns."""
    found = repeated_runs(documents, min_lines, id_col, text_col) if min_words is None else repeated_passages(documents, min_lines, min_words, id_col, text_col)
    runs = found.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    names = fresh(documents.columns, "_d", "_h", "_runs")
    runs = runs.toDF(*names).hint("merge")  # one plan at every size: the runs grow with the corpus
    joined = documents.join(runs, (documents[id_col] == runs[names[0]]) & (F.xxhash64(documents[text_col]) == runs[names[1]]), "left")
    lines, cut = split_lines(documents[text_col]), F.col(names[2])
    kept = F.when(cut.isNull(), lines).otherwise(F.filter(lines, lambda _, i: ~F.exists(cut, lambda r: (i >= r["start"]) & (i < r["stop"]))))
    return joined, cut, lines, kept


def dedup_lines(documents: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """The documents with the later copies of repeated line runs deleted from their text; all other columns, whatever their names, and rows stay. A text
    without runs stays byte for byte; a text of which all is deleted becomes empty; null ids or texts are left alone. With
    `min_words`, the runs are those of repeated_passages."""
    joined, cut, _, kept = with_runs(documents, min_lines, id_col, text_col, min_words)
    text = F.when(cut.isNull(), documents[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else documents[c] for c in documents.columns])


def line_dedup_digest(documents: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """(id, n_lines, n_removed, n_runs, kept_sha256) for each row; a null text has no lines and counts as empty. `min_words` is as in
    dedup_lines."""
    documents = documents.select(id_col, text_col)
    joined, cut, lines, kept = with_runs(documents, min_lines, id_col, text_col, min_words)
    zero = F.lit(0).cast(T.LongType())
    total = F.coalesce(F.size(lines).cast("long"), zero)
    total = F.when(documents[text_col].isNull(), zero).otherwise(total)
    text = F.coalesce(F.when(cut.isNull(), documents[text_col]).otherwise(F.array_join(kept, "\n")), F.lit(""))
    removed = F.coalesce(F.aggregate(cut, zero, lambda a, r: a + (r["stop"] - r["start"]).cast("long")), zero)
    runs = F.greatest(F.coalesce(F.size(cut).cast("long"), zero), zero)
    return joined.select(documents[id_col], total.alias("n_lines"), removed.alias("n_removed"), runs.alias("n_runs"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB.
ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, line, lead(line, 1) OVER p AS b, lead(line, 2) OVER p AS c FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, b, c ORDER BY doc_id, i) AS k FROM w
      WHERE c IS NOT NULL AND regexp_matches(line, '\\S') AND regexp_matches(b, '\\S') AND regexp_matches(c, '\\S')),
cut AS (SELECT DISTINCT doc_id, i + o AS i FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1),
m AS (SELECT l.doc_id, l.i, l.line, cut.i IS NOT NULL AS gone FROM l LEFT JOIN cut ON cut.doc_id = l.doc_id AND cut.i = l.i),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM m),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id
"""
