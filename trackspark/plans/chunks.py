"""Windows over long tracks in two levels: within chunks of a track, and over the chunks.

A chunk is a stretch of a track's order of bounded length, and a partition of the windows within; so a track of any
length is dealt to many tasks. How many tasks there are follows the rows, so that what one of them sorts stays the same. What a chunk needs of the others is carried to it: each chunk is summed up in one row,
windows over those rows (one for CHUNK points) give what comes before or after, and a join brings it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folders import work_folder

#: Places in a track's order that a chunk has.
CHUNK = 1 << 17
#: Rows of cut tracks that a task has, about; some have a few chunks more.
TASK = 1 << 16
_NUMBER = "_chunk"
#: Attribute of results that says how many rows their tracks have at most, and how many tasks cut ones are dealt to, so that the next operator needn't look again.
_SPAN = "_trackspark_span"
#: The chunk of rows that have no place in the order: they come first.
_NOWHERE = -(1 << 62)


def _tasks(df: DataFrame, rows: int) -> int:
    """How many tasks so many rows are dealt to."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK))


class Chunks:
    """Rows cut by an order, or whole tracks where there are no more rows, or places that the order spans, than a chunk has.

    Where rows are fewer than others that were cut already, or about as many, like says so instead. rows has the chunk's
    number where tracks are cut, and is dealt by chunks; drop() takes it away. Windows and carry serve both cases alike.
    """

    def __init__(self, df: DataFrame, order: str = "seq", size: int | None = None, like: Chunks | None = None, key: str = "track_id"):
        size = size or CHUNK
        self.by, self.span, self.tasks = [order], None, None
        if like is None:
            self.span, self.tasks = getattr(df, _SPAN, None) or (None, None) if order == "seq" else (None, None)
            if self.span is None:  # counting rows needs no column; only tables of many rows are looked at
                rows = df.count()
                self.span = rows if rows < size else min(rows, (df.agg(F.max(order) - F.min(order)).first()[0] or 0) + 1)
                self.tasks = _tasks(df, rows)
        else:
            self.tasks = like.tasks
        self.cut = self.span > size if like is None else like.cut
        self.of, self.key = key, [key, *[_NUMBER] * self.cut]
        self.rows = self._dealt(df.withColumn(_NUMBER, F.coalesce(F.floor(F.col(order) / F.lit(size)).cast("bigint"), F.lit(_NOWHERE)))) if self.cut else df

    @classmethod
    def of_times(cls, df: DataFrame, time: str, *ties: str, size: int | None = None, key: str = "track_id") -> Chunks:
        """Rows with times cut into equal spans of each key's, of about size rows; rows of one time stay together, ordered by ties."""
        size = size or CHUNK
        spans = df.groupBy(F.col(key).alias("_of")).agg(F.count("*").alias("_n"), F.min(time).alias("_t0"), F.max(time).alias("_t1"))
        most, rows = spans.agg(F.max("_n"), F.sum("_n")).first()
        out = cls.__new__(cls)
        out.by, out.span, out.tasks, out.cut, out.rows = [time, *ties], None, _tasks(df, rows or 0), (most or 0) > size, df
        out.of, out.key = key, [key, *[_NUMBER] * out.cut]
        if out.cut:
            folder = work_folder(df.sparkSession)
            spans.select("_of", "_t0", ((F.col("_t1") - F.col("_t0")) / F.ceil(F.col("_n") / size)).alias("_width")).write.parquet(folder)
            held = df.sparkSession.read.parquet(folder)
            number = F.coalesce(F.floor((F.col(time) - F.col("_t0")) / F.nullif("_width", F.lit(0.0))).cast("bigint"), F.lit(0))
            out.rows = out._dealt(df.join(held, F.col(key).eqNullSafe(F.col("_of"))).withColumn(_NUMBER, number).drop("_of", "_t0", "_width"))
        return out

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows by chunks, in a number of tasks that adaptive execution doesn't lower."""
        return rows.repartition(self.tasks, *self.key)

    def _place(self) -> Column:
        return F.col(self.by[0]) if len(self.by) == 1 else F.struct(*self.by)

    def window(self):
        return Window.partitionBy(*self.key).orderBy(*self.by)

    def backward(self):
        """The other way round: a frame that ends ahead would be read anew for each row."""
        return Window.partitionBy(*self.key).orderBy(*(F.desc(c) for c in self.by))

    def earlier(self):
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def so_far(self):
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def latest(self, value: Column | str) -> Column:
        """Aggregate of a chunk: its last value that isn't null."""
        value = F.col(value) if isinstance(value, str) else value
        return F.max_by(value, F.when(value.isNotNull(), self._place()))

    def earliest(self, value: Column | str) -> Column:
        """Aggregate of a chunk: its first value that isn't null."""
        value = F.col(value) if isinstance(value, str) else value
        return F.min_by(value, F.when(value.isNotNull(), self._place()))

    def first(self, value: Column) -> Column:
        return F.min_by(value, self._place())

    def last(self, value: Column) -> Column:
        return F.max_by(value, self._place())

    def carry(self, rows: DataFrame, **parts: tuple[Column, str]) -> DataFrame:
        """rows with a column for each part: (aggregate of a chunk, how chunks combine); null where there is nothing to carry.

        How: 'previous' or 'next', that of the chunk beside; 'sum', 'max' or 'last' (not null), over all chunks before;
        'first', the first that isn't null of those behind.
        The chunks' rows are a table in the shared folder, so that plans stay as long as the number of carries.
        """
        if not self.cut:
            return rows.withColumns({name: F.lit(None) for name in parts})
        totals = rows.groupBy(F.col(self.of).alias("_of"), F.col(_NUMBER).alias("_at")).agg(*(what.alias(name) for name, (what, _) in parts.items()))
        order = Window.partitionBy("_of").orderBy("_at")
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy("_of").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
        combine = {
            "previous": lambda c: F.lag(c).over(order), "next": lambda c: F.lead(c).over(order), "sum": lambda c: F.sum(c).over(earlier),
            "max": lambda c: F.max(c).over(earlier), "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
            "first": lambda c: F.last(c, ignorenulls=True).over(later),
        }
        folder = work_folder(rows.sparkSession)
        totals.select("_of", "_at", *(combine[how](name).alias(name) for name, (_, how) in parts.items())).write.parquet(folder)
        held = rows.sparkSession.read.parquet(folder)
        return rows.join(held, F.col(self.of).eqNullSafe(F.col("_of")) & (F.col(_NUMBER) == F.col("_at")), "left").drop("_of", "_at")

    def drop(self, rows: DataFrame) -> DataFrame:
        """rows without the chunks' numbers; it is known how long their tracks are at most."""
        return self.spanned(rows.drop(_NUMBER))

    def spanned(self, rows: DataFrame) -> DataFrame:
        """rows of the same places, of which it is known how long their tracks are at most."""
        if self.span is not None and self.by == ["seq"]:
            setattr(rows, _SPAN, (self.span, self.tasks))
        return rows
