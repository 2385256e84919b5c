"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from panewise.functions.arith import div
from panewise.functions.draws import md5_draw
from panewise.functions.text import (
    parse_key_payload,
    tokenize,
    word_with_count,
    word_with_count_text,
)
from panewise.functions.time import micros_since_1970
from panewise.operators import count_window as windows
from panewise.functions.permute import ROUNDS, grid, md5_noise, permuted
from panewise.operators import counter, histogram, throughput, zipf, zipf_sampling
from panewise.plans import jobs
from panewise.session import forget, working_dir
from panewise.sources import generate, io
from panewise.streaming import microbatch, state, stateful
from panewise.streaming.run import run_to_end, timed_write

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return add


# Inputs ---------------------------------------------------------------------------------------

DAY_MS = 24 * 3600 * 1000
PAUSE_MS = 20 * 60 * 1000

# Splits a key past this many rows, in chunks of 2^6 and 2^4: makes the splitting of hot keys happen
# on small tables too.
SMALL_HOT_ROWS = 40
SMALL_BITS = (6, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return io.read_table(spark, f"{sf_dir}/documents.parquet", *columns)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_table(spark, f"{sf_dir}/orders.parquet", "o_orderkey")


def cents(rows: DataFrame) -> DataFrame:
    """Money as whole cents, so that sums are exact in any order."""
    return rows.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


# Micro-batches of the event streams, and rows of a file in them.
PARTS = 3
FILE_ROWS = 1 << 20

# The event type of a row after all others, which moves the watermark past them.
LAST = "end of input"


@functools.cache
def event_parts(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A folder with the events as PARTS parts in their order, and then one with a last row a week later; and the
    number of files of each part.

    Rows without an id are in the last part. A part is as many files as its rows need, all parts the same
    number, so that a micro-batch of that many files is one part.
    """
    path = working_dir(spark, "event-parts")
    rows = events(spark, sf_dir)
    ends = rows.agg(F.min("event_id"), F.max("event_id"), F.count(F.lit(1))).first()
    share = ((ends[1] or 0) - (ends[0] or 0)) // PARTS + 1
    part = F.coalesce(div(F.col("event_id") - F.lit(ends[0] or 0), share), F.lit(PARTS - 1))
    files = -(-ends[2] // (PARTS * FILE_ROWS)) or 1
    for i in range(PARTS):
        some = rows.where(part == i)
        dealt = some.coalesce(1) if files == 1 else some.repartition(files)
        dealt.write.mode("append").parquet(f"{path}/events")
    last = rows.where(F.col("event_id") == ends[1]).limit(1)
    last = last.withColumns({"event_type": F.lit(LAST), "ts": F.col("ts") + F.expr("interval 7 days")})
    last.coalesce(1).write.parquet(f"{path}/last")
    return path, files


def event_stream(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """The events, a part in each micro-batch."""
    path, files = event_parts(spark, sf_dir)
    reader = spark.readStream.schema(events(spark, sf_dir).schema).option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path}/{{events{',last' if last else ''}}}")


def streamed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A glob matches the table whether it is one file or a folder of files.
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def key_payload_lines(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", F.concat_ws(" ", "user_id", "event_type").alias("value"))


# SQL parts ------------------------------------------------------------------------------------

_BLANKS = r"[ \t\n\x0b\f\r]"
_BODY = rf"regexp_replace(text, '{_BLANKS}+$', '')"
WORDS = (
    f"select unnest(case when {_BODY} = '' and text <> '' then [] "
    f"else string_split_regex({_BODY}, '{_BLANKS}') end) as word from documents"
)
WORD_SEQUENCE = (
    "select row_number() over (order by doc_id, place) as seq, word from (select doc_id, "
    f"unnest(string_split_regex({_BODY}, '{_BLANKS}')) as word, "
    f"generate_subscripts(string_split_regex({_BODY}, '{_BLANKS}'), 1) as place "
    f"from documents where not ({_BODY} = '' and text <> ''))"
)
NUMBERED = (
    "select *, row_number() over (partition by user_id order by event_id) as n, "
    "round(value * 100)::bigint as cents from events"
)


def pane_counts_sql(rows: str, key: str, size: int, slide: int) -> str:
    return (
        f"select {key}, j * {slide} as n, least(j * {slide}, {size}) as cnt from (select {key}, "
        f"unnest(range(1, (count(*) // {slide}) + 1)) as j from ({rows}) group by {key})"
    )


def sliding_sql(select: str, size: int, slide: int) -> str:
    frame = (
        f"(partition by user_id order by event_id rows between {size - 1} preceding and current row)"
    )
    return (
        f"select user_id, n, {select} from (select *, {frame_select(select, frame)} from ({NUMBERED})) "
        f"where n % {slide} = 0"
    )


def frame_select(names: str, frame: str) -> str:
    forms = {
        "cnt": f"count(*) over {frame} as cnt",
        "total": f"(sum(cents) over {frame})::bigint as total",
        "lowest": f"min(cents) over {frame} as lowest",
        "highest": f"max(cents) over {frame} as highest",
        "mean": f"(sum(cents) over {frame})::double / count(*) over {frame} as mean",
        "oldest": f"first_value(event_type) over {frame} as oldest",
    }
    return ", ".join(forms[name.strip()] for name in names.split(","))


def uniform_sql(id_: str, seed: int) -> str:
    digits = f"substr(md5(({id_})::varchar || ':{seed}'), 1, 13)"
    return f"(('0x' || {digits})::bigint / 4503599627370496.0::double)"


def below_sql(draw: str, bound: str) -> str:
    return f"least(floor({draw} * ({bound})::double)::bigint, ({bound})::bigint - 1)"


# Words and count windows ----------------------------------------------------------------------


@register("word_count", f"select word, count(*) as cnt from ({WORDS}) group by word")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(tokenize(documents(spark, sf_dir, "text"), "text"), "word")


@register(
    "word_count_printed",
    f"select word || ' : ' || count(*) as value from ({WORDS}) group by word",
)
def word_count_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_count(spark, sf_dir)
    return counts.select(word_with_count_text(word_with_count("word", "cnt")).alias("value"))


@register("count_window_words", pane_counts_sql(WORDS, "word", 10, 3))
def count_window_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize(documents(spark, sf_dir, "text"), "text")
    return windows.count_window_counts(words, ["word"], 10, 3)


@register(
    "window_word_count_job",
    "select '(' || word || ',' || cnt || ')' as value from "
    f"({pane_counts_sql(WORDS, 'word', 10, 3)}) where word = 'the'",
)
def window_word_count_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.window_word_count(documents(spark, sf_dir, "text"), 10, 3, word="the", column="text")


def _count_window(size: int, slide: int) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return windows.count_window_counts(events(spark, sf_dir), ["user_id"], size, slide)

    return run


for _name, _size, _slide in (("sliding", 10, 3), ("tumbling", 5, 5), ("sampling", 3, 10)):
    register(
        f"count_window_{_name}", pane_counts_sql("select user_id from events", "user_id", _size, _slide)
    )(_count_window(_size, _slide))


def _window_aggregates(size: int, slide: int, **options) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        aggs = [
            F.count(F.lit(1)).alias("cnt"),
            F.sum("cents").alias("total"),
            (F.sum("cents").cast("double") / F.count(F.lit(1))).alias("mean"),
            F.min_by("event_type", "n").alias("oldest"),
        ]
        rows = cents(events(spark, sf_dir))
        return windows.count_window(rows, ["user_id"], "event_id", size, slide, aggs, **options)

    return run


for _name, _size, _slide in (("sliding", 10, 3), ("tumbling", 5, 5), ("sampling", 3, 10)):
    register(
        f"count_window_aggregates_{_name}", sliding_sql("cnt, total, mean, oldest", _size, _slide)
    )(_window_aggregates(_size, _slide))

register("count_window_aggregates_split_keys", sliding_sql("cnt, total, mean, oldest", 10, 3))(
    _window_aggregates(10, 3, hot_rows=SMALL_HOT_ROWS, bits=SMALL_BITS)
)


@register(
    "count_window_mean_long",
    "select event_type, n, mean, lowest from (select event_type, row_number() over (partition by event_type "
    "order by event_id) as n, avg(cents) over w as mean, min(cents) over w as lowest from (select *, "
    "round(value * 100)::bigint as cents from events) window w as (partition by event_type order by event_id "
    "rows between 999 preceding and current row))",
)
def count_window_mean_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.avg("cents").alias("mean"), F.min("cents").alias("lowest")]
    return windows.count_window(cents(events(spark, sf_dir)), ["event_type"], "event_id", 1000, 1, aggs)


def _window_reduce(how: str, into: str, size: int, slide: int) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = cents(events(spark, sf_dir))
        return windows.count_window_reduce(
            rows, ["user_id"], "event_id", "cents", how, size, slide, into
        )

    return run


register("count_window_sum", sliding_sql("total", 10, 3))(_window_reduce("sum", "total", 10, 3))
register("count_window_sum_long", sliding_sql("total", 48, 2))(_window_reduce("sum", "total", 48, 2))
register("count_window_min_long", sliding_sql("lowest", 40, 1))(_window_reduce("min", "lowest", 40, 1))
register("count_window_max_long", sliding_sql("highest", 35, 2))(_window_reduce("max", "highest", 35, 2))


def _money(rows: DataFrame) -> DataFrame:
    return rows.withColumn("money", (F.round(F.col("value") * 100).cast("decimal(12,0)") / 100).cast("decimal(10,2)"))


def decimal_sql(size: int, slide: int) -> str:
    return (
        f"select {size}::bigint as size, user_id, n, (total / 100.0)::decimal(20,2) as total from "
        f"({sliding_sql('total', size, slide)})"
    )


@register("count_window_sum_decimal", f"{decimal_sql(10, 3)} union all {decimal_sql(48, 2)}")
def count_window_sum_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few and many panes per row: one type of result."""
    rows = _money(events(spark, sf_dir))

    def summed(size: int, slide: int) -> DataFrame:
        panes = windows.count_window_reduce(rows, ["user_id"], "event_id", "money", "sum", size, slide, "total")
        return panes.select(F.lit(size).cast("bigint").alias("size"), "user_id", "n", "total")

    return summed(10, 3).union(summed(48, 2))


# Histograms of whole-stream panes -------------------------------------------------------------


def pane_sql(rows: str, word: str, size: int, slide: int) -> str:
    return (
        f"with s as ({rows}), p as (select {word}, unnest(range((seq + {slide - 1}) // {slide}, "
        f"(seq + {size - 1}) // {slide} + 1)) as pane from s), h as (select pane, {word}, "
        f"count(*) as cnt from p where pane * {slide} <= (select count(*) from s) group by all) "
    )


EVENT_SEQUENCE = "select row_number() over (order by event_id) as seq, event_type from events"


def _pane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.stream_histogram(events(spark, sf_dir), "event_type", "event_id", 100, 50)


@register("pane_histogram", pane_sql(EVENT_SEQUENCE, "event_type", 100, 30) + "select * from h")
def pane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.stream_histogram(events(spark, sf_dir), "event_type", "event_id", 100, 30)


@register("pane_histogram_coprime", pane_sql(EVENT_SEQUENCE, "event_type", 1000, 7) + "select * from h")
def pane_histogram_coprime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No two rows always share their panes: panes follow from what changes between them."""
    return histogram.stream_histogram(events(spark, sf_dir), "event_type", "event_id", 1000, 7)


TOP_TWO = (
    pane_sql(EVENT_SEQUENCE, "event_type", 100, 50)
    + "select * from (select *, row_number() over (partition by pane order by cnt desc, event_type) "
    "as r from h) where r <= 2"
)


@register(
    "pane_topk",
    pane_sql(EVENT_SEQUENCE, "event_type", 100, 50)
    + "select * from (select *, row_number() over (partition by pane order by cnt desc, event_type) "
    "as r from h) where r <= 2",
)
def pane_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.top_words(_pane_histogram(spark, sf_dir), "event_type", 2)


@register(
    "pane_bottomk_distinct",
    pane_sql(EVENT_SEQUENCE, "event_type", 100, 50)
    + "select * from (select *, row_number() over (partition by pane order by cnt) as r from "
    "(select pane, cnt, min(event_type) as event_type from h group by pane, cnt)) where r <= 2",
)
def pane_bottomk_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.bottom_counts(_pane_histogram(spark, sf_dir), "event_type", 2)


@register(
    "pane_top_words",
    pane_sql(WORD_SEQUENCE, "word", 5000, 2500)
    + "select * from (select *, row_number() over (partition by pane order by cnt desc, word) "
    "as r from h) where r <= 3",
)
def pane_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents(spark, sf_dir, "doc_id", "text")
    return histogram.top_words_of_lines(lines, "text", "doc_id", 5000, 2500, 3)


@register(
    "pane_topk_long",
    pane_sql(WORD_SEQUENCE, "word", 20_000, 500)
    + "select * from (select *, row_number() over (partition by pane order by cnt desc, word) "
    "as r from h) where r <= 3",
)
def pane_topk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 panes per word: words that can't be among the three are never sent to them."""
    lines = documents(spark, sf_dir, "doc_id", "text")
    return histogram.top_words_of_lines(lines, "text", "doc_id", 20_000, 500, 3)


# Running counter ------------------------------------------------------------------------------

COUNTED = f"select user_id, n, event_type from ({NUMBERED})"


@register("running_counter", COUNTED)
def running_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter.running_counter(events(spark, sf_dir), "user_id", "event_id", "event_type")


@register("running_counter_split_keys", COUNTED)
def running_counter_split_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter.running_counter(
        events(spark, sf_dir), "user_id", "event_id", "event_type",
        hot_rows=SMALL_HOT_ROWS, bits=SMALL_BITS,
    )


@register(
    "running_counter_hot_types",
    "select event_type, row_number() over (partition by event_type order by event_id) as n, user_id "
    "from events",
)
def running_counter_hot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keys hold all rows: every one of them is split."""
    return counter.running_counter(
        events(spark, sf_dir), "event_type", "event_id", "user_id",
        hot_rows=SMALL_HOT_ROWS, bits=SMALL_BITS,
    )


@register("running_counter_strict", f"select 0::bigint as user_id, n, event_type from ({NUMBERED})")
def running_counter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter.running_counter(
        events(spark, sf_dir), "user_id", "event_id", "event_type", strict=True
    )


@register(
    "keyed_counter_job",
    f"select '(' || user_id || ',' || n || ',' || event_type || ')' as value from ({NUMBERED}) "
    "where user_id = 1",
)
def keyed_counter_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.keyed_counter(key_payload_lines(events(spark, sf_dir)), "event_id")


@register(
    "key_payload_parse", "select event_id, user_id::int as key, event_type as payload from events"
)
def key_payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_key_payload(key_payload_lines(events(spark, sf_dir)), keep=("event_id",))


FINAL = (
    "select user_id, count(*) as n, arg_max(event_type, event_id) as event_type from events "
    "group by user_id"
)


@register("counter_final_state", FINAL)
def counter_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter.final_state(events(spark, sf_dir), "user_id", "event_id", "event_type")


def broken_lines(rows: DataFrame) -> DataFrame:
    """Every fifth line has no payload, every seventh no integer key."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    line = (
        F.when(F.col("event_id") % 5 == 0, user)
        .when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), user, F.lit(" "), kind))
        .otherwise(F.concat_ws(" ", user, kind))
    )
    return rows.select("event_id", line.alias("value"))


@register(
    "key_payload_drop",
    "select event_id, user_id::int as key, event_type as payload from events "
    "where event_id % 5 <> 0 and event_id % 7 <> 0",
)
def key_payload_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_key_payload(broken_lines(events(spark, sf_dir)), keep=("event_id",), on_error="drop")


@register("text_file_counter", f"select user_id::int as key, n, event_type as payload from ({NUMBERED})")
def text_file_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written to several text files and read back, numbered by file and place."""
    path = working_dir(spark, "lines")
    rows = events(spark, sf_dir).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    io.write_lines(key_payload_lines(rows), path)
    records = io.written(parse_key_payload(io.read_lines(spark, path, order="line"), keep=("line",)), "records")
    forget(spark, path)
    return counter.running_counter(records, "key", "line", "payload")


# Generators, one draw per order ---------------------------------------------------------------

_CUSTOMERS = "(select count(*) from customer)"
CDF = (
    f"with k as (select count(*)::bigint as k from part), "
    "r as (select i as rank, k, floor(pow(2.0, 50 - ceil(log2(1 + ln(k)))) / i::double)::bigint as w "
    "from k, range(1, k + 1) t(i)), "
    "c as (select rank, (hi - w)::bigint as lo, hi::bigint as hi, "
    "((rank * (2147483647 % k)) % k + 1)::varchar as word "
    "from (select *, sum(w) over (order by rank) as hi from r))"
)
DRAWN = (
    f"{CDF}, t as (select sum(w)::bigint as total from r), "
    f"u as (select o_orderkey, {below_sql(uniform_sql('o_orderkey', 0), 'total')} as u from orders, t), "
    "d as (select o_orderkey, rank, word from u join c on u >= lo and u < hi)"
)


def _parts(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").count()


@register("zipf_cdf", f"{CDF} select * from c")
def zipf_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipf.zipf_cdf(spark, _parts(spark, sf_dir), 1.0)


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return zipf.draw_words(rows, "o_orderkey", _parts(spark, sf_dir), 1.0, draw=md5_draw)


@register("zipf_words", f"{DRAWN} select o_orderkey, rank, word from d")
def zipf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(spark, sf_dir).select("o_orderkey", "rank", "word")


# Words in a random order, and draws without a table; numbers of words are those of `part`.


def noise_sql(place: str, key: str) -> str:
    return f"('0x' || substr(md5(({place})::varchar || ':' || ({key})), 1, 13))::bigint"


def permuted_sql(numbers: str, n: str) -> str:
    """`x, y` for the rows `x` of `numbers`: the rounds of `permuted` with seed 0, on a grid of its sides."""
    rounds = "m0 as (select x, y // low as a, y % low as b, high, low, n from walk where y >= n or not moved), "
    for i in range(ROUNDS):
        a, b = ("a", f"(b + {noise_sql('a', str(i))} % low) % low") if i % 2 else (f"(a + {noise_sql('b', str(i))} % high) % high", "b")
        rounds += f"m{i + 1} as (select x, {a} as a, {b} as b, high, low, n from m{i}), "
    moved = rounds.removesuffix(", ")
    return (
        f"side as (select n, ceil(sqrt(n))::bigint as high from (select {n} as n)), "
        "box as (select n, high, (n + high - 1) // high as low from side), "
        f"walk as (select x, x as y, false as moved, high, low, n from ({numbers}), box union all "
        f"(with {moved} select x, a * low + b, true, high, low, n from m{ROUNDS})), "
        "settled as (select x, y from walk where moved and y < n)"
    )


@register(
    "zipf_words_shuffled",
    "with recursive k as (select count(*)::bigint as k from part), "
    f"{permuted_sql('select unnest(range(k)) as x from k', '(select k from k)')} "
    "select x + 1 as rank, (y + 1)::varchar as word from settled",
)
def zipf_words_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _parts(spark, sf_dir)
    ranks = spark.range(1, words + 1).withColumnRenamed("id", "rank")
    return ranks.withColumn("word", (permuted(F.col("rank") - 1, words, 0, md5_noise) + 1).cast("string"))


SAMPLED_WORDS, SAMPLED_SKEW = 10**9, 1.2


def sampled_sql(words: int, skew: float) -> str:
    least, most, sure = (f"{b!r}::double" for b in zipf_sampling.bounds(words, skew))
    one, back = f"{1.0 - skew!r}::double", f"{1.0 / (1.0 - skew)!r}::double"
    draws = uniform_sql("o_orderkey", 0).replace("':0'", "':' || t")
    return (
        f"with u as (select o_orderkey, t, {most} + {draws} * ({least} - {most}) as y from orders, "
        f"range({zipf_sampling.TRIES}) r(t)), "
        f"x as (select *, pow(1.0::double + y * {one}, {back}) as x from u), "
        f"k as (select *, least(greatest(floor(x + 0.5)::bigint, 1), {words}) as k from x), "
        f"good as (select * from k where k - x <= {sure} or "
        f"y >= (pow(k::double + 0.5, {one}) - 1.0) / {one} - pow(k::double, {-skew!r}::double)) "
        "select o_orderkey, arg_min(k, t)::bigint as rank from good group by o_orderkey"
    )


@register("zipf_ranks_sampled", sampled_sql(SAMPLED_WORDS, SAMPLED_SKEW))
def zipf_ranks_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A billion words, for each order one of them."""
    rank = zipf_sampling.sampled_rank(F.col("o_orderkey"), SAMPLED_WORDS, SAMPLED_SKEW, 0, md5_draw)
    return orders(spark, sf_dir).select("o_orderkey", rank.alias("rank"))


@register(
    "zipf_count_window",
    f"{DRAWN} select * from ({pane_counts_sql('select word from d', 'word', 10, 3)})",
)
def zipf_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.count_window_counts(_drawn(spark, sf_dir), ["word"], 10, 3)


@register(
    "key_payload_table",
    f"with p as (select pid, string_agg(chr((97 + {below_sql(uniform_sql('pid * 8 + j', 2), '26')})::int), '' "
    "order by j) as payload from range(1000) a(pid), range(8) b(j) group by pid), "
    f"d as (select o_orderkey, {below_sql(uniform_sql('o_orderkey', 0), _CUSTOMERS)} as key, "
    f"{below_sql(uniform_sql('o_orderkey', 1), '1000')} as pid from orders) "
    "select o_orderkey, key || ' ' || payload as value from d join p using (pid)",
)
def key_payload_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").count()
    return generate.key_payloads(orders(spark, sf_dir), "o_orderkey", customers, 8, draw=md5_draw)


# Throughput -----------------------------------------------------------------------------------

DAYS = (
    "select date_trunc('day', ts)::timestamp as start, count(*) as n, count(*) / 86400.0::double as thp "
    "from events group by 1"
)


def sessions_sql(by: str) -> str:
    part = f"partition by {by} " if by else ""
    shown = f"{by}, " if by else ""
    return (
        f"select {shown}min(ts) as start, max(ts) as end, count(*) as n, case when max(ts) > min(ts) "
        "then count(*)::double / (date_diff('microsecond', min(ts), max(ts)) / 1e6) end as thp "
        "from (select *, sum(case when ts - p > interval 1200 second then 1 else 0 end) "
        f"over ({part}order by ts) as sid from (select *, lag(ts) over ({part}order by ts) as p "
        f"from events)) group by {shown}sid"
    )


@register("throughput_tumbling", DAYS)
def throughput_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput.fixed_time(events(spark, sf_dir), "ts", DAY_MS)


WARM_MEAN = (
    # Days 2 to 6, or to the last there is; a day without rows has rate 0.
    f"with d as ({DAYS}), b as (select min(start) as first, max(start) as last from d), r as (select "
    "first + to_days(i::int) as start from b, range(1, 6) t(i) where first + to_days(i::int) <= last) "
    "select sum(coalesce(n, 0))::double / (count(*) * 86400.0::double) as thp from r left join d using (start)"
)


@register("throughput_warm_mean", WARM_MEAN)
def throughput_warm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput.warm_mean(throughput_tumbling(spark, sf_dir), DAY_MS)


@register("throughput_until_idle", sessions_sql(""))
def throughput_until_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput.until_idle(events(spark, sf_dir), "ts", PAUSE_MS)


@register("throughput_until_idle_by_type", sessions_sql("event_type"))
def throughput_until_idle_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput.until_idle(events(spark, sf_dir), "ts", PAUSE_MS, by=["event_type"])


FILLED = (
    'select start, "end", 500.0::double / (date_diff(\'microsecond\', start, "end") / 1e6) as thp from '
    '(select max(ts) filter (i = 100) as start, max(ts) filter (i = 600) as "end" from '
    "(select ts, row_number() over (order by event_id) as i from events))"
)


@register("throughput_after_fill", FILLED)
def throughput_after_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput.after_fill(events(spark, sf_dir), "ts", "event_id", 100, 500)


AFTER_FILL = "select 500.0::double / (date_diff('microsecond', start, \"end\") / 1e6) as thp from " + (
    '(select max(ts) filter (i = 100) as start, max(ts) filter (i = 600) as "end" from '
    "(select ts, row_number() over (order by event_id) as i from events))"
)


@register("metric_file", AFTER_FILL)
def metric_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure written to its file and read back."""
    path = working_dir(spark, "metric")
    io.write_metric(throughput_after_fill(spark, sf_dir), path)
    return io.read_metric(spark, path)


@register("timed_write_rows", "select count(*) as \"rows\" from events")
def timed_write_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a timed batch write reports; its rate depends on the machine and is left out."""
    path, rows = working_dir(spark, "sent"), events(spark, sf_dir)
    measured = timed_write(spark, rows.count(), lambda: io.write_lines(key_payload_lines(rows), path))
    forget(spark, path)
    return measured.select("rows")


# Streams --------------------------------------------------------------------------------------


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Run a stream of new rows to its end and read what it wrote."""
    path = working_dir(spark, "stream")
    run_to_end(spark, io.sink(rows, "parquet", f"{path}/checkpoint", path=f"{path}/rows"))
    forget(spark, f"{path}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _latest(spark: SparkSession, result: DataFrame, keys: list[str]) -> DataFrame:
    """Run a streaming aggregation to its end and read the last row of each key."""
    path = working_dir(spark, "stream")
    run_to_end(spark, microbatch.changed_rows(result, f"{path}/rows", f"{path}/checkpoint"))
    forget(spark, f"{path}/checkpoint")
    return microbatch.read_latest(spark, f"{path}/rows", keys)


def _batches(spark: SparkSession, write: Callable) -> DataFrame:
    """Run a micro-batch form, given where to write and its checkpoint, to its end and read its output."""
    path = working_dir(spark, "stream")
    run_to_end(spark, write(f"{path}/rows", f"{path}/checkpoint"))
    forget(spark, f"{path}/checkpoint")
    return microbatch.read_output(spark, f"{path}/rows")


@register("stream_running_counter", COUNTED)
def stream_running_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    return _batches(
        spark, lambda out, state: microbatch.running_counter(rows, "user_id", "event_id", "event_type", out, state)
    )


@register("stream_running_counter_state", COUNTED)
def stream_running_counter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stateful.running_counter(event_stream(spark, sf_dir), "user_id", "event_type", "event_id")
    return _streamed(spark, counted)


@register("stream_count_window", pane_counts_sql("select user_id from events", "user_id", 10, 3))
def stream_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stateful.count_window_counts(event_stream(spark, sf_dir), "user_id", 10, 3)
    return _streamed(spark, counts)


@register("stream_count_window_batches", pane_counts_sql("select user_id from events", "user_id", 10, 3))
def stream_count_window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    return _batches(spark, lambda out, state: microbatch.count_window_counts(rows, "user_id", 10, 3, out, state))


def _stream_panes(spark: SparkSession, sf_dir: str, size: int, slide: int) -> DataFrame:
    rows = event_stream(spark, sf_dir)
    return _batches(
        spark, lambda out, state: microbatch.pane_histogram(rows, "event_type", "event_id", size, slide, out, state)
    )


@register("stream_pane_histogram", pane_sql(EVENT_SEQUENCE, "event_type", 1000, 30) + "select * from h")
def stream_pane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panes of all rows, numbered through all micro-batches."""
    return _stream_panes(spark, sf_dir, 1000, 30)


@register("stream_pane_topk", TOP_TWO)
def stream_pane_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.top_words(_stream_panes(spark, sf_dir, 100, 50), "event_type", 2)


@register("stream_count_window_sum", sliding_sql("total", 10, 3))
def stream_count_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents(event_stream(spark, sf_dir))
    return _batches(
        spark,
        lambda out, state: microbatch.count_window_reduce(
            rows, "user_id", "event_id", "cents", "sum", 10, 3, out, state, into="total"
        ),
    )


@register(
    "stream_count_window_sum_state",
    "select user_id, n, total from (select user_id, n, (sum(odd_cents) over (partition by user_id order by "
    "event_id rows between 9 preceding and current row))::bigint as total from (select *, case when "
    f"event_id % 3 <> 0 then cents end as odd_cents from ({NUMBERED}))) where n % 3 = 0",
)
def stream_count_window_sum_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a column of which every third value is null."""
    rows = cents(event_stream(spark, sf_dir)).withColumn("cents", F.when(F.col("event_id") % 3 != 0, F.col("cents")))
    return _streamed(
        spark, stateful.count_window_reduce(rows, "user_id", "cents", "sum", 10, 3, "event_id", into="total")
    )


@register("stream_state_table", FINAL)
def stream_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the counter's store holds when the stream has ended, read from the checkpoint as a table."""
    counted = stateful.running_counter(event_stream(spark, sf_dir), "user_id", "event_type", "event_id")
    path = working_dir(spark, "stream")
    run_to_end(spark, io.sink(counted, "parquet", f"{path}/checkpoint", path=f"{path}/rows"))
    forget(spark, f"{path}/rows")
    return state.counter_table(spark, f"{path}/checkpoint", "user_id", "event_type")


@register("stream_final_state", FINAL)
def stream_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = stateful.final_state(event_stream(spark, sf_dir), "user_id", "event_id", "event_type")
    return _latest(spark, state, ["user_id"])


def _timed_stream(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """Zoneless times read as UTC, as watermarks need a time with a zone."""
    rows = event_stream(spark, sf_dir, last)
    return rows.withColumn("ts", F.timestamp_micros(micros_since_1970(rows, "ts"))).withWatermark("ts", "1 hour")


def _zoneless(rows: DataFrame, *columns: str) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return rows.withColumns(
        {c: epoch + F.make_dt_interval(secs=F.unix_micros(c).cast("decimal(24,6)") / 1_000_000) for c in columns}
    )


@register("stream_throughput", DAYS)
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = throughput.fixed_time(_timed_stream(spark, sf_dir), "ts", DAY_MS)
    return _zoneless(_latest(spark, rates, ["start"]), "start")


@register("stream_warm_mean", WARM_MEAN)
def stream_warm_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the rates of a stream's days 2 to 6; days leave the state once the watermark has passed them."""
    rates = throughput.fixed_time(_timed_stream(spark, sf_dir), "ts", DAY_MS)
    return throughput.warm_mean(_latest(spark, rates, ["start"]), DAY_MS)


@register("stream_after_fill", FILLED)
def stream_after_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times of two rows of the whole order, whichever micro-batches they come in."""
    rows = event_stream(spark, sf_dir)
    return _batches(
        spark, lambda out, state: microbatch.after_fill(rows, "ts", "event_id", 100, 500, out, state)
    )


@register("stream_until_idle", sessions_sql("event_type"))
def stream_until_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions leave the state once the watermark has passed them; a last row moves it past all."""
    rows = _timed_stream(spark, sf_dir, last=True)
    sessions = throughput.until_idle_stream(rows, "ts", "event_type", PAUSE_MS)
    return _zoneless(_streamed(spark, sessions).where(F.col("event_type") != LAST), "start", "end")


@register("stream_job_rows", "select count(*) as \"rows\" from events")
def stream_job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a whole-job measure reports; its rate depends on the machine and is left out."""
    path = working_dir(spark, "stream")
    counted = stateful.final_state(event_stream(spark, sf_dir), "user_id", "event_id", "event_type")
    measured = run_to_end(spark, microbatch.replace_table(counted, f"{path}/rows", f"{path}/checkpoint"))
    forget(spark, path)
    return measured.select("rows")


@register("stream_zipf_words", f"{DRAWN} select o_orderkey, rank, word from d")
def stream_zipf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word for every order of a stream; the table of words is made once."""
    words = _parts(spark, sf_dir)
    rows = streamed_table(spark, sf_dir, "orders").select("o_orderkey")
    known = zipf.word_table(spark, words, 1.0)
    drawn = zipf.draw_words(rows, "o_orderkey", words, 1.0, draw=md5_draw, table=known)
    return _streamed(spark, drawn.select("o_orderkey", "rank", "word"))


@register(
    "keyed_counter_stream_job",
    f"select '(' || user_id || ',' || n || ',' || event_type || ')' as value from ({NUMBERED}) "
    "where user_id = 1",
)
def keyed_counter_stream_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = key_payload_lines(event_stream(spark, sf_dir))
    return _streamed(spark, jobs.stream_keyed_counter(lines, order_by="event_id"))


@register(
    "window_word_count_stream_job",
    "select '(' || word || ',' || cnt || ')' as value from "
    f"({pane_counts_sql(WORDS, 'word', 10, 3)}) where word = 'the'",
)
def window_word_count_stream_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = streamed_table(spark, sf_dir, "documents").select("text")
    return _streamed(spark, jobs.stream_window_word_count(lines, 10, 3, word="the", column="text"))
