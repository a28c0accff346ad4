"""Point sets from files and tables: (row_id, x array<double>), with labels where there are any."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outrate.operators.neighbors import within
from outrate.operators.state import kept

#: Entropies and distortions of the illustration of a lower hull.
HULL_ENTROPIES = (15, 12, 10, 7, 5, 3, 11, 6, 19, 7.6, 11, 17, 16, 17, 16.5, 18.3, 19, 15.5, 16, 14, 15)
HULL_DISTORTIONS = (30, 110, 200, 400, 620, 900, 600, 890, 400, 750, 380, 170, 220, 230, 260, 280, 350, 330, 300, 380, 399)
HULL_POINTS = [(float(d), float(h)) for d, h in zip(HULL_DISTORTIONS, HULL_ENTROPIES, strict=True)]


def table_points(df: DataFrame, key: str, columns: list[str], cluster: str | None = None) -> DataFrame:
    """Rows of a table as points; cluster: an expression for a label, numbered from 1 in its order."""
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    out = df.select(F.col(key).cast("long").alias("row_id"), x, *([F.expr(cluster).alias("__label")] if cluster else []))
    if not cluster:
        return out
    labels = out.select("__label").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("__label")).cast("long"))
    return out.join(labels, "__label").select("row_id", "cluster", "x")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start, place) of all lines of a file or a folder of them: Spark reads them by ranges of bytes, of which ``start`` tells
    the begin, and ``place`` the order within.  A written table."""
    found = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return kept(found.withColumn("place", F.monotonically_increasing_id()))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of ``lines``, or some of them, with row_id from 1 in the order of files by name and of lines in them: each range counts its own
    rows, and what the ranges before it hold, a row for each range, is added."""
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    counts = rows.groupBy("file", "start").agg(F.count("*").alias("n")).select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "start").orderBy("place"))
    return rows.withColumn("own", own).join(counts, ["file", "start"]).withColumn("row_id", F.col("own") + F.col("before")).drop("own", "before", "file", "start", "place").sortWithinPartitions("row_id")


#: An attribute's name: quoted, with blanks perhaps, or a word.
_ATTRIBUTE = re.compile(r"""@attribute\s+(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|(\S+))""", re.IGNORECASE)
#: A value: quoted, with commas perhaps, or up to the next comma.
_VALUE = r"""\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|([^,]*))\s*(?:,|$)"""


def arff(spark: SparkSession, path: str, features: str = "named") -> DataFrame:
    """A dense ARFF file, or a folder of files of which the first has the header: row_id (from 1, in order of files and lines), x, src_id,
    is_outlier.  A value that is no number, as ?, is null.

    features ``named``: all attributes but id and outlier; ``positional``: all but the last two, whatever they are.
    """
    every = lines(spark, path)
    heads = every.where("lower(ltrim(value)) LIKE '@attribute%'").orderBy("file", "start", "place").collect()  # the header
    names = [next(g for g in _ATTRIBUTE.match(r.value.strip()).groups() if g is not None).lower() for r in heads]
    use = [i for i, n in enumerate(names) if n not in ("id", "outlier")] if features == "named" else list(range(len(names) - 2))
    data = in_order(every.where("trim(value) <> '' AND NOT ltrim(value) RLIKE '^[@%]'"))
    parts = [F.regexp_extract_all("value", F.lit(_VALUE), F.lit(k)) for k in (1, 2, 3)]
    data = data.withColumn("f", F.transform(F.arrays_zip(*parts), lambda v: F.trim(F.concat(v["0"], v["1"], v["2"]))))
    at = lambda i: F.try_element_at("f", F.lit(i + 1))
    src = at(names.index("id")).try_cast("double") if "id" in names else F.lit(None).cast("double")
    return data.select(F.col("row_id").cast("long").alias("row_id"), F.array(*[at(i).try_cast("double") for i in use]).alias("x"), src.alias("src_id"), (at(names.index("outlier")) == "yes").alias("is_outlier"))


def datasets(spark: SparkSession, paths: dict[str, str], features: str = "named") -> DataFrame:
    """Several ARFF files with the dataset's name."""
    out = None
    for name, path in paths.items():
        one = arff(spark, path, features).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def separated(spark: SparkSession, path: str, columns: int, sep: str = " ") -> DataFrame:
    """The first columns of header-less separated numbers; blank lines do not count, repeated rows do."""
    f = F.split(F.trim("value"), r"\s+" if sep == " " else sep)
    rows = in_order(lines(spark, path).where("trim(value) <> ''"))
    return rows.select(F.col("row_id").cast("long").alias("row_id"), F.array(*[F.trim(f[i]).cast("double") for i in range(columns)]).alias("x"))


def uniform(row: Column, seed: int) -> Column:
    """A number over 0, of 1 at most, from a hash of the row's id: the same however rows are dealt out."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", row.cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def disc_noise(ids: DataFrame, seed: int = 1) -> DataFrame:
    """For each row_id: y * (cos, sin)(2 pi x) for normal x and uniform y."""
    u = [uniform(F.col("row_id"), seed + i) for i in range(3)]
    normal = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])
    t = ids.select("row_id", (2 * F.pi() * normal).alias("t"), u[2].alias("y"))
    return t.select("row_id", F.array(F.col("y") * F.cos("t"), F.col("y") * F.sin("t")).alias("x"))


#: Where noise for the map of Europe is drawn (least and greatest longitude, latitude), how far it keeps from all else, and
#: the four points it starts with.
NOISE_BOX, NOISE_GAP = ((-40.0, 80.0), (25.0, 90.0)), 3.5
NOISE_FIRST = ((-20.0, 40.0), (-10.0, 80.0), (60.0, 41.0), (70.0, 60.0))


def sparse_noise(points: DataFrame, n: int = 100, seed: int = 1, drawn: int = 20, most: int = 1 << 20) -> DataFrame:
    """(row_id, x) of n points: the four first ones, then uniform draws that keep their distance from points (row_id, x) and from all noise
    accepted before them.  ``drawn`` draws for each point are made at once, and twice as many again while too few are accepted; where n points
    are not among ``most`` draws, there is no room for them, which is an error.  A draw is accepted when all those before it that are near are
    rejected, which gives what one draw after another gives."""
    spark, size = points.sparkSession, n * drawn
    shifted = kept(points.select((-F.col("row_id") - 1).alias("row_id"), "x"))  # apart from the ids of draws
    while True:
        draws = kept(_draws(spark, size, seed))
        chosen = kept(_accepted(draws, shifted).orderBy("row_id").limit(n))
        if chosen.count() == n:
            return draws.join(chosen, "row_id")
        if size >= most:
            raise ValueError(f"no room for {n} points: {chosen.count()} were accepted among {size} draws")
        size = min(most, 2 * size)


def _draws(spark: SparkSession, size: int, seed: int) -> DataFrame:
    (x0, x1), (y0, y1) = NOISE_BOX
    row = F.col("id") + len(NOISE_FIRST)
    t = spark.range(size).select(row.alias("row_id"), F.array(x0 + (x1 - x0) * uniform(row, seed), y0 + (y1 - y0) * uniform(row, seed + 1)).alias("x"))
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(NOISE_FIRST)], "row_id long, x array<double>").union(t)


def _accepted(draws: DataFrame, taken: DataFrame) -> DataFrame:
    """(row_id) of the draws that keep their distance from taken, whose ids are below 0, and from accepted draws before them."""
    close = within(draws.union(taken), NOISE_GAP, 2).where(f"a >= {len(NOISE_FIRST)} AND d < {NOISE_GAP}")
    open_ = kept(draws.select("row_id").join(close.where("b < 0").select(F.col("a").alias("row_id")).distinct(), "row_id", "left_anti"))
    before = kept(close.where("b >= 0 AND b < a").select("a", "b"))
    accepted = draws.where("false").select("row_id")
    while not open_.isEmpty():
        waits = before.join(open_.select(F.col("row_id").alias("a")), "a").join(open_.select(F.col("row_id").alias("b")), "b").select("a").distinct()
        now = kept(open_.join(waits.select(F.col("a").alias("row_id")), "row_id", "left_anti"))
        accepted = accepted.union(now)
        gone = before.join(now.select(F.col("row_id").alias("b")), "b").select(F.col("a").alias("row_id")).union(now).distinct()
        open_ = kept(open_.join(gone, "row_id", "left_anti"))
    return accepted


def write_arff(points: DataFrame, path: str, names: list[str]) -> None:
    """points (row_id, x, is_outlier) as ARFF files in order of row_id, the first of which has the header."""
    spark = points.sparkSession
    quoted = ["'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" if not n.isidentifier() else n for n in names]
    head = ["@RELATION points", "", "@ATTRIBUTE id real", *(f"@ATTRIBUTE {n} real" for n in quoted), "@ATTRIBUTE outlier {'no','yes'}", "", "@DATA"]
    line = F.concat_ws(",", F.col("row_id").cast("string"), F.array_join(F.transform("x", lambda v: v.cast("string")), ",", "?"), F.when(F.col("is_outlier"), "'yes'").otherwise("'no'"))
    rows = spark.createDataFrame([(0, i, h) for i, h in enumerate(head)], "a int, b long, value string").union(points.select(F.lit(1), "row_id", line))
    rows.repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("value").write.text(path)


def write_separated(points: DataFrame, path: str, sep: str = " ") -> None:
    """points (row_id, x) as header-less separated numbers, in files in order of row_id."""
    points.repartitionByRange("row_id").sortWithinPartitions("row_id").select(F.array_join(F.transform("x", lambda v: v.cast("string")), sep).alias("value")).write.text(path)
