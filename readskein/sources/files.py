"""FASTA, cluster, constraint, edge and cost files as DataFrames, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import EditCosts
from ..functions.bases import fasta_record
from ..operators.chunks import number_in_key


#: Ids on a line of a cluster file.
LINE_IDS = 65_536


def _numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Rows numbered over all partitions in the given order, without sorting them in one task."""
    keyed = number_in_key(df.withColumn("key", F.lit(0)), "key", order)
    return keyed.withColumn(name, F.col("_number") + start).drop("key", "_number", "_chunk")


def _records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """Records between separators, with file and place. A file is read whole by its splits."""
    return spark.read.option("lineSep", sep).text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))


def parse_fasta(records: DataFrame) -> DataFrame:
    """(id, clone, bases) of each record in column value, without ``>`` at its start or with it.

    The id is the token after ``>``, the clone the token after the word ``clone``; bases keep [-A-Za-z0-9] only.
    """
    record = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "^[ \\t]*>", "")
    header, body = F.regexp_extract(record, r"^([^\n]*)", 1), F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1)
    blank = lambda c: F.when(c != "", c)
    return records.where(F.trim("value") != "").select(
        *[c for c in records.columns if c != "value"],
        blank(F.regexp_extract(header, r"^\s*(\S+)", 1)).alias("id"),
        blank(F.regexp_extract(header, r"(?:^|\s)clone\s+(\S+)", 1)).alias("clone"),
        F.regexp_replace(body, "[^-A-Za-z0-9]", "").alias("bases"),
    )


def read_fasta(spark: SparkSession, path: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """(seq_id, id, clone, bases, len) in the order of the file, numbered from ``start``; ``limit`` keeps the first reads."""
    rows = _numbered(parse_fasta(_records(spark, path, "\n>")), ["file", "place"], "seq_id", start)
    if limit is not None:
        rows = rows.where(F.col("seq_id") < start + limit)
    return rows.select("seq_id", F.coalesce("id", F.col("seq_id").cast("string")).alias("id"), "clone", "bases", F.length("bases").alias("len"))


def write_fasta(reads: DataFrame, path: str, width: int = 80) -> None:
    reads.select(fasta_record("id", "clone", "bases", width).alias("value")).write.text(path)


def parse_clusters(lines: DataFrame, start: int = 0) -> DataFrame:
    """(cluster_id, ord, seq_id) of the lines in column value, in the order of column place.

    A cluster ends with a full stop and may take several lines; where no line has a stop, each line is a cluster. Ids
    are shifted by ``start``; clusters are named by their least read.
    """
    stops = lines.agg(F.count_if(F.col("value").contains("."))).first()[0]
    if stops:
        # Stops before each line: counted within the partition that numbered it, plus those of the partitions before.
        ends = F.when(F.col("value").contains("."), 1).otherwise(0)
        part = F.shiftright("place", 33)
        sums = lines.groupBy(part.alias("part")).agg(F.sum(ends).alias("n"))
        # one row for each partition of the input
        first = sums.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
        before = F.sum("ends").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        grouped = lines.withColumns({"part": part, "ends": ends}).withColumn("before", F.coalesce(before, F.lit(0))).join(first, F.col("part") == F.col("of")).withColumn("at", F.col("first") + F.col("before"))
    else:
        grouped = lines.withColumn("at", F.col("place"))
    ids = F.expr("filter(split(translate(value, '.', ' '), '[ \\t]+'), x -> x rlike '^[0-9]+$')")
    flat = grouped.select("at", "place", F.posexplode(ids).alias("p", "x")).select("at", "place", "p", (F.col("x").cast("bigint") + start).alias("seq_id"))
    least = flat.groupBy("at").agg(F.min("seq_id").alias("cluster_id"))
    return number_in_key(flat, "at", ["place", "p"]).join(least, "at").select("cluster_id", F.col("_number").alias("ord"), "seq_id")


def read_clusters(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(cluster_id, ord, seq_id) of a compressed cluster table, whose lines end with a full stop or have none."""
    return parse_clusters(_records(spark, path, "\n").select("value", "place"), start)


def cluster_lines(clusters: DataFrame, stop: bool = True) -> DataFrame:
    """(cluster_id, line): members ascending, separated by blanks, with a full stop at the end."""
    ids = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("seq_id")), lambda x: x.cast("string")))
    return clusters.groupBy("cluster_id").agg(F.concat(ids, F.lit("." if stop else "")).alias("line"))


def cluster_line_parts(clusters: DataFrame, size: int = LINE_IDS) -> DataFrame:
    """(cluster_id, part, line): the members of each cluster in order, in lines of at most ``size``; only the last line of
    a cluster has a full stop, so readers put the lines together, and no row holds a large cluster whole."""
    numbered = number_in_key(clusters.select("seq_id", "cluster_id"), "cluster_id", ["seq_id"], size)
    sizes = clusters.groupBy("cluster_id").agg((F.ceil(F.count("*") / size) - 1).cast("bigint").alias("last"))
    ids = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("seq_id")), lambda x: x.cast("string")))
    lines = numbered.groupBy("cluster_id", F.col("_chunk").alias("part")).agg(ids.alias("ids")).join(sizes, "cluster_id")
    return lines.select("cluster_id", "part", F.concat("ids", F.when(F.col("part") == F.col("last"), ".").otherwise("")).alias("line"))


def write_clusters(clusters: DataFrame, path: str) -> None:
    cluster_line_parts(clusters).orderBy("cluster_id", "part").select(F.col("line").alias("value")).write.text(path)


def translated(clusters: DataFrame, reads: DataFrame, to: str = "id") -> tuple[DataFrame, DataFrame]:
    """(clusters, missing) between numbers and names of reads: with ``to`` "id", (cluster_id, seq_id) become
    (cluster_id, id), with "seq_id", (cluster_id, id) become (cluster_id, seq_id). ``missing`` has what ``reads`` (seq_id,
    id) don't know. A name of two reads is an error; members that are missing are left out, and null ones too."""
    known = reads.select("seq_id", "id").where("seq_id is not null and id is not null").distinct()
    if not known.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("several reads have the same id")
    of = "seq_id" if to == "id" else "id"
    given = clusters.select("cluster_id", of).where(F.col(of).isNotNull())
    return given.join(known, of).select("cluster_id", to), given.join(known, of, "left_anti").select(of).distinct()


def read_two_clusters(spark: SparkSession, path: str, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(seq_id) of the first and of the second line of a file of two lists of numbers; further lines are left out."""
    lines = _numbered(_records(spark, path, "\n").where(F.trim("value") != ""), ["file", "place"], "line")
    ids = F.expr("filter(split(translate(value, '.', ' '), '[ \\t\\r]+'), x -> x rlike '^[0-9]+$')")
    flat = lines.where("line < 2").select("line", F.explode(ids).alias("x")).select("line", (F.col("x").cast("bigint") + start).alias("seq_id")).distinct()
    return flat.where("line = 0").select("seq_id"), flat.where("line = 1").select("seq_id")


def extended_table(clusters: DataFrame, witness: DataFrame | None = None) -> DataFrame:
    """(index, cluster, link, orient, witness) from (seq_id, cluster_id); link is the next member, -1 at the end.

    Without ``witness`` (seq_id, witness, orient), orient is 0 and witness -1, as when converted from lines.
    """
    from ..operators.chunks import next_in_key

    linked = next_in_key(clusters.select("seq_id", "cluster_id"), "cluster_id", "seq_id", "seq_id", "link")
    out = linked.select(F.col("seq_id").alias("index"), F.col("cluster_id").alias("cluster"), F.coalesce("link", F.lit(-1)).cast("bigint").alias("link"))
    if witness is None:
        return out.withColumn("orient", F.lit(0)).withColumn("witness", F.lit(-1).cast("bigint"))
    other = witness.select(F.col("seq_id").alias("_s"), F.col("witness").alias("_w"), F.col("orient").alias("_o"))
    joined = out.join(other, F.col("index") == F.col("_s"), "left")
    return joined.select("index", "cluster", "link", F.coalesce("_o", F.lit(1)).cast("int").alias("orient"), F.coalesce("_w", F.lit(-1)).cast("bigint").alias("witness"))


def from_extended(table: DataFrame) -> DataFrame:
    """(seq_id, cluster_id) of an extended table; the rest can be made from it."""
    return table.select(F.col("index").alias("seq_id"), F.col("cluster").alias("cluster_id"))


def read_extended(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"[,\s]+")
    names = [("index", "bigint"), ("cluster", "bigint"), ("link", "bigint"), ("orient", "int"), ("witness", "bigint")]
    return spark.read.text(path).where(F.trim("value") != "").select(*[f[i].cast(t).alias(n) for i, (n, t) in enumerate(names)])


def write_extended(table: DataFrame, path: str) -> None:
    table.orderBy("index").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("index", "cluster", "link", "orient", "witness")]).alias("value")).write.text(path)


def parse_edges(lines: DataFrame) -> DataFrame:
    """(i, j, strand) of dump lines ``i j dir`` or ``thread: i j dir``; a dir of 0 is read as -1."""
    f = F.split(F.trim(F.regexp_replace("value", r"^\s*\d+:\s*", "")), r"\s+")
    rows = lines.where(F.col("value").rlike(r"\d+\s+\d+\s+-?\d+\s*$")).select(f[0].cast("bigint").alias("i"), f[1].cast("bigint").alias("j"), f[2].cast("int").alias("d"))
    return rows.select("i", "j", F.when(F.col("d") > 0, 1).otherwise(-1).alias("strand"))


DIRECTIVES = ("fix", "cluster-only", "cluster-others", "reset", "reset-others")


def parse_constraints(lines: DataFrame, start: int = 0) -> DataFrame:
    """(directive, seq_id) of constraint lines; a directive without ids has one row with null seq_id.

    Directives are read in either case; more than one of cluster-only and reset is an error.
    """
    word = F.lower(F.regexp_extract("value", r"^\s*([A-Za-z\-]+)", 1))
    ids = F.expr(r"filter(split(translate(value, '.', ' '), '\\s+'), x -> x rlike '^[0-9]+$')")
    rows = lines.select(word.alias("directive"), ids.alias("ids")).where(F.col("directive").isin(*DIRECTIVES))
    if rows.where(F.col("directive").isin("cluster-only", "reset")).limit(2).count() > 1:
        raise ValueError("at most one of cluster-only and reset")
    return rows.select("directive", F.explode_outer("ids").alias("x")).select("directive", (F.col("x").cast("bigint") + start).alias("seq_id"))


def read_constraints(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    return parse_constraints(spark.read.text(path), start)


MANUAL_COSTS = EditCosts(tuple(tuple(-1 if a == b else 3 for b in range(4)) for a in range(4)), 5, 2)


def parse_costs(text: str) -> EditCosts:
    """Four rows of four costs (A, C, G, T), then the costs of opening and extending a gap."""
    n = [int(x) for x in text.split()]
    if len(n) < 18:
        raise ValueError("18 numbers expected")
    return EditCosts(tuple(tuple(n[4 * r : 4 * r + 4]) for r in range(4)), n[16], n[17])


def klink_lines(links: DataFrame) -> DataFrame:
    """(line): ``i:j1 j2.`` of (seq_id, neighbours)."""
    return links.select(F.concat(F.col("seq_id").cast("string"), F.lit(":"), F.concat_ws(" ", F.transform("neighbours", lambda x: x.cast("string"))), F.lit(".")).alias("line"))


def parse_klinks(lines: DataFrame) -> DataFrame:
    """(seq_id, neighbours) of lines ``i:j1 j2.``"""
    ids = F.expr(r"transform(filter(split(translate(split(value, ':')[1], '.', ' '), ' +'), x -> x <> ''), x -> cast(x as bigint))")
    return lines.where(F.col("value").contains(":")).select(F.split("value", ":")[0].cast("bigint").alias("seq_id"), ids.alias("neighbours"))


def literal_ids(spark: SparkSession, text: str) -> DataFrame:
    """(seq_id) of a list of numbers given in place, separated by blanks or commas."""
    return spark.createDataFrame([(int(x),) for x in text.replace(",", " ").replace(".", " ").split()], "seq_id bigint")


def header_clusters(reads: DataFrame, sep: str = "_") -> DataFrame:
    """(cluster_id, seq_id): reads whose ids begin alike up to the separator; the id is the least read."""
    prefix: Column = F.split_part("id", F.lit(sep), F.lit(1))
    least = reads.groupBy(prefix.alias("prefix")).agg(F.min("seq_id").alias("cluster_id"))
    return reads.select("seq_id", prefix.alias("prefix")).join(least, "prefix").select("cluster_id", "seq_id")
