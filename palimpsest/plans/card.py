"""State cards, and the choice of candidates when the card's own size counts.

A card takes the first eight texts of four classes and the eight smallest tool names
of the chosen rows, so its size depends on the choice and the choice on its size.  The
rows above the floor are chosen whatever the card; a card is bounded, so only the rows
just under the floor are open.  A choice is a number of rows in walk order.  Either all sessions weigh their
cards together and move on by set steps, or each open row is an option with the cost of its card, from
running sums of what every row adds to the card's lists, and the choice is a minimum over options.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import fixed
from palimpsest.functions.text import cut_bytes
from palimpsest.operators.ordered import block, exclusive_sums, line_levels, newest
from palimpsest.plans.base import Plans
from palimpsest.plans.policy import KEYS
from palimpsest.session import cut

LISTS = ["files_touched", "decisions", "errors", "open_tasks"]

CARD_TYPE = T.StructType(
    [
        T.StructField("goal", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("concepts", T.ArrayType(T.StringType())),
        *[T.StructField(name, T.ArrayType(T.StringType())) for name in LISTS],
        T.StructField("current_work", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("covers_items", T.LongType()),
    ]
)

def goal_summary(goal: str | Column) -> Column:
    """The goal, trimmed and cut to 120 bytes."""
    goal = F.col(goal) if isinstance(goal, str) else goal
    return cut_bytes(F.trim(goal), 120, 117, "...")


def _size(text: str | Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _smallest(rows: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """``_m0`` to ``_m7``: the smallest (k, size) so far, in order, on each row.

    What a row brings competes with the smallest so far; the greater of the two goes on to compete for the next place, and so on. Each place is a running
    minimum, so one sorted pass finds all eight.
    """
    over = f"(PARTITION BY {', '.join(part)} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND {{}})"
    query = "SELECT *, struct(k, size) AS _x0 FROM {rows}"
    for i in range(fixed.CARD_LIST_MAX):
        held = f"min(_x{i}) OVER {over.format('1 PRECEDING')}"
        query = f"SELECT *, min(_x{i}) OVER {over.format('CURRENT ROW')} AS _m{i}, {held} AS _h{i} FROM ({query})"
        query = f"SELECT *, if(_h{i} IS NULL OR _x{i} IS NULL, NULL, greatest(_h{i}, _x{i})) AS _x{i + 1} FROM ({query})"
    names = ", ".join([*rows.columns, *[f"_m{i}" for i in range(fixed.CARD_LIST_MAX)]])
    return rows.sparkSession.sql(f"SELECT {names} FROM ({query})", rows=rows)


def _list_growth(base: DataFrame, opened: DataFrame, part: list[str]) -> DataFrame:
    """``part``, place and ``growth``: by how many bytes the eight smallest of a list grow when an open row joins those before it.

    ``base``: part, k, size, the list at the outset; ``opened``: part, place, k, size. Rows are windowed by blocks of places; a block starts with
    the eight smallest of all before it, which are found from the eight smallest of each block.
    """
    blocks = [*part, "_block"]
    rows = opened.withColumn("_block", block("place") + 1)
    every = rows.select(*blocks, "k", "size").unionByName(base.withColumn("_block", F.lit(0).cast("long")).select(*blocks, "k", "size"))
    tops = newest(every, blocks, [F.col("k")], fixed.CARD_LIST_MAX).drop("_rank")
    levels = F.array_compact(F.array(*[F.col(f"_m{i}") for i in range(fixed.CARD_LIST_MAX)]))
    ends = _smallest(tops, part, ["_block", "k"]).groupBy(*blocks).agg(F.max_by(levels, "k").alias("_list"))
    starts = ends.withColumn("_list", F.lag("_list").over(Window.partitionBy(*part).orderBy("_block"))).filter("_block > 0")
    carried = starts.select(*blocks, F.explode("_list").alias("e")).select(*blocks, F.lit(-1).cast("long").alias("place"), "e.k", "e.size")
    order = ["place", "k"]
    both = _smallest(rows.select(*blocks, "place", "k", "size").unionByName(carried), blocks, order)
    total = sum((F.coalesce(F.col(f"_m{i}.size"), F.lit(0)) for i in range(1, fixed.CARD_LIST_MAX)), F.col("_m0.size"))
    both = both.withColumn("_total", total)
    was = F.coalesce(F.lag("_total").over(Window.partitionBy(*blocks).orderBy(*order)), F.lit(0))
    return both.withColumn("growth", F.col("_total") - was).filter("place >= 0").select(*part, "place", "growth")


def _by_line() -> Column:
    return F.struct(F.col("line_index").alias("line"), F.lit("").alias("name")).alias("k")


def _by_name() -> Column:
    return F.struct(F.lit(0).cast("long").alias("line"), F.col("tool").alias("name")).alias("k")


LIST = [*KEYS, "card_class"]


def _entries(rows: DataFrame, *more: str) -> DataFrame:
    """What rows bring to a card's lists: texts by line, and tool names by name, each at its first place."""
    place = [F.min(c).alias(c) for c in more] or [F.lit(0).alias("_")]
    named = rows.filter("tool <> ''").groupBy(*KEYS, "tool").agg(*place)
    return rows.select(*LIST, *more, _by_line(), _size("text").alias("size")).unionByName(
        named.select(*KEYS, F.lit("concepts").alias("card_class"), *more, _by_name(), _size("tool").alias("size"))
    )


def _open(rows: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where each session starts (KEYS, taken, left), its card's lists there, and the rows it may still take."""
    base = rows.join(heads.select(*KEYS, "floor_tokens", "_low"), KEYS)
    settled = base.filter(F.col("remaining") > F.col("floor_tokens"))
    # A card's bound says which rows it can never take. Where it may exceed the floor itself, every row is open.
    opened = base.filter(
        (F.col("remaining") <= F.col("floor_tokens")) & ((F.col("remaining") > F.col("_low")) | (F.col("_low") <= 0))
    )
    opened = cut(opened.select(*LIST, "line_index", "text", "tool", "place", _after().alias("left")), "open")
    listed = newest(settled, LIST, [F.col("line_index")], fixed.CARD_LIST_MAX).select(*LIST, _by_line(), _size("text").alias("size"))
    named = newest(settled.filter("tool <> ''").select(*KEYS, "tool").distinct(), KEYS, [F.col("tool")], fixed.CARD_LIST_MAX)
    held = cut(listed.unionByName(named.select(*KEYS, F.lit("concepts").alias("card_class"), _by_name(), _size("tool").alias("size"))), "card-lists")
    start = cut(settled.groupBy(*KEYS).agg(F.count("*").alias("taken"), F.min(_after()).alias("left")), "start")
    return start, held, opened


def _cost(lists: Column, taken: Column) -> Column:
    """Tokens of a card, from the bytes of its lists."""
    size = lists + F.col("_fixed") + _size(_summary(F.col("goal_summary"), taken))
    return F.greatest(F.ceil(size / fixed.BYTES_PER_TOKEN), F.lit(1)).cast("long")


def _first_fit(start: DataFrame, held: DataFrame, opened: DataFrame, heads: DataFrame) -> DataFrame:
    """KEYS, taken, left, cost: the first number of rows that fits together with its card, else all."""
    new = _entries(opened, "place").join(held.select(*LIST, "k"), [*LIST, "k"], "left_anti")
    growth = _list_growth(held, new, LIST).groupBy(*KEYS, "place").agg(F.sum("growth").alias("_growth"))
    sized = exclusive_sums(opened.select(*KEYS, "place", "left").join(growth, [*KEYS, "place"], "left"), KEYS, line_levels("place"), {"_grown": F.col("_growth")})
    first = start.join(held.groupBy(*KEYS).agg(F.sum("size").alias("_held")), KEYS, "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    first = cut(first, "first")
    grown = F.col("_held") + F.col("_grown") + F.coalesce("_growth", F.lit(0))
    later = sized.join(first.select(*KEYS, "_held"), KEYS).select(*KEYS, (F.col("place") + 1).alias("taken"), "left", grown.alias("_lists"))
    told = first.select(*KEYS, "taken", "left", F.col("_held").alias("_lists")).unionByName(later).join(heads.select(*KEYS, "floor_tokens", "_fixed", "goal_summary"), KEYS)
    option = F.struct("taken", "left", _cost(F.col("_lists"), F.col("taken")).alias("cost"))
    fits = option["left"] + option["cost"] <= F.col("floor_tokens")
    return told.groupBy(*KEYS).agg(F.coalesce(F.min(F.when(fits, option)), F.max(option)).alias("o")).select(*KEYS, "o.*")


def _by_steps(start: DataFrame, held: DataFrame, opened: DataFrame, heads: DataFrame) -> DataFrame:
    """KEYS, taken, left, cost: a session takes what its present card costs, until it fits or nothing is left to take.

    Each step weighs the cards of all sessions that still move, from the eight first of each list; sessions move together, and few move more than twice.
    """
    own = heads.select(*KEYS, "floor_tokens", "_fixed", "goal_summary")
    state, done = start, None
    while True:
        taken = _entries(opened.join(state.select(*KEYS, "taken"), KEYS).filter(F.col("place") < F.col("taken")))
        lists = held.join(state.select(*KEYS), KEYS, "left_semi").unionByName(taken).distinct()
        weight = newest(lists, LIST, [F.col("k")], fixed.CARD_LIST_MAX).groupBy(*KEYS).agg(F.sum("size").alias("_lists"))
        now = state.join(own, KEYS).join(weight, KEYS, "left").withColumn("cost", _cost(F.coalesce("_lists", F.lit(0)), F.col("taken")))
        now = cut(now.select(*KEYS, "taken", "left", "cost", "floor_tokens", F.greatest(F.col("floor_tokens") - F.col("cost"), F.lit(0)).alias("_room")), "weighed")
        option = F.struct((F.col("place") + 1).alias("taken"), "left")
        ahead = opened.join(now.select(*KEYS, "taken", "_room"), KEYS).filter(F.col("place") >= F.col("taken")).groupBy(*KEYS).agg(
            F.coalesce(F.min(F.when(F.col("left") <= F.col("_room"), option)), F.max(option)).alias("_next")
        )
        still = (F.col("left") + F.col("cost") <= F.col("floor_tokens")) | (F.col("left") <= F.col("_room")) | F.col("_next").isNull()
        moved = cut(now.join(ahead, KEYS, "left").withColumn("_still", still), "moved")
        stay = moved.filter("_still").select(*KEYS, "taken", "left", "cost")
        done = stay if done is None else done.unionByName(stay)
        state = moved.filter(~F.col("_still")).select(*KEYS, "_next.*")
        if state.isEmpty():
            return done


def _after() -> Column:
    return F.greatest(F.col("remaining") - F.col("savings"), F.lit(0))


def _summary(goal_summary: Column, taken: Column) -> Column:
    return F.coalesce(goal_summary, F.concat(F.lit(f"{fixed.CARD_NAME} covering "), taken.cast("string"), F.lit(" elided items")))


def choose_with_card(
    strategy: str,
    ranked: DataFrame,
    sessions: DataFrame,
    *,
    one_by_one: bool = False,
    stub: str = fixed.STUB,
) -> Plans:
    """Plan of a strategy that adds a state card.

    ``ranked`` has the candidates with ``remaining`` (context left before the row is
    taken) and ``place`` (its number in walk order).  A session whose context is at or under the floor has no plan.
    ``one_by_one`` takes the first option that fits with its card; otherwise a session moves by what its present card costs.
    """
    rows = cut(
        ranked.select(
            *KEYS, "line_index", "savings", "tool", "card_class", "text", "remaining", "place"
        ),
        "ranked",
    )
    scope = sessions.select(*KEYS, "context_tokens", "floor_tokens", "goal", "current_work")
    # Most bytes a card of this session can have: every list full of its longest text.
    bounds = rows.groupBy(*KEYS).agg(F.max(F.octet_length("text")).alias("_text"), F.max(F.octet_length("tool")).alias("_tool"))
    context = F.concat(F.lit("provider: "), F.col("provider"))
    heads = scope.join(bounds, KEYS).withColumn("goal_summary", goal_summary("goal")).withColumn(
        "_fixed", fixed.CARD_BASE_BYTES + _size("goal") + _size("current_work") + _size(context)
    )
    most = F.col("_fixed") + _size("goal_summary") + 64 + 8 * (4 * _size_of("_text") + _size_of("_tool"))
    heads = cut(heads.withColumn("_low", F.col("floor_tokens") - F.ceil(most / 4)), "heads")
    option = cut((_first_fit if one_by_one else _by_steps)(*_open(rows, heads), heads), "settled")
    chosen = cut(rows.join(option.select(*KEYS, "taken"), KEYS).filter(F.col("place") < F.col("taken")), "chosen-rows")
    listed = newest(chosen, [*KEYS, "card_class"], [F.col("line_index")], fixed.CARD_LIST_MAX)
    entries = F.sort_array(F.collect_list(F.when(F.col("_class").isNotNull(), F.struct("_class", "_line", "_entry"))))  # eight of each class at most
    named = newest(chosen.filter("tool <> ''").select(*KEYS, "tool").distinct(), KEYS, [F.col("tool")], fixed.CARD_LIST_MAX)
    shown = listed.select(*KEYS, F.col("card_class").alias("_class"), F.col("line_index").alias("_line"), F.col("text").alias("_entry")).unionByName(
        named.select(*KEYS, F.lit("concepts").alias("_class"), F.col("_rank").cast("long").alias("_line"), F.col("tool").alias("_entry"))
    ).groupBy(*KEYS).agg(entries.alias("_shown"))

    def entry(name: str) -> Column:
        return F.transform(F.filter("_shown", lambda e: e["_class"] == name), lambda e: e["_entry"]).alias(name)

    card = F.struct(
        F.col("goal"), _summary(F.col("goal_summary"), F.col("taken")).alias("summary"), entry("concepts"), *[entry(n) for n in LISTS],
        F.col("current_work"), context.alias("context"), F.col("taken").alias("covers_items"),
    ).cast(CARD_TYPE)
    edits = chosen.select(
        *KEYS, F.lit(strategy).alias("strategy"), F.lit("elide").alias("op"), "line_index", "savings", F.lit(stub).alias("stub"),
    )
    firsts = chosen.groupBy(*KEYS).agg(F.min("line_index").alias("first_line"))
    plans = heads.join(option, KEYS).join(firsts, KEYS).join(shown, KEYS, "left").select(
        *KEYS,
        F.lit(strategy).alias("strategy"),
        F.col("context_tokens").alias("tokens_before"),
        (F.col("left") + F.col("cost")).alias("tokens_after"),
        F.col("taken").alias("edits"),
        "first_line",
        F.col("cost").alias("overhead"),
        card.alias("card"),
    )
    return Plans(plans, edits)


def _size_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def render_card(card: str | Column, marker: str = fixed.CARD_MARKER) -> Column:
    """A card as text: the marker, one line per entry, and how many records it covers."""
    c = F.col(card) if isinstance(card, str) else card

    def lines(name: str, prefix: str) -> Column:
        return F.transform(F.coalesce(c[name], F.expr("array()").cast("array<string>")),
                           lambda t: F.concat(F.lit(prefix), t))

    def line(name: str, prefix: str) -> Column:
        return F.concat(F.lit(prefix), c[name])

    return F.concat_ws(
        "\n",
        F.lit(marker),
        line("goal", "goal: "),
        line("summary", "summary: "),
        lines("concepts", "concept: "),
        lines("files_touched", "file: "),
        lines("decisions", "decision: "),
        lines("errors", "error: "),
        lines("open_tasks", "todo: "),
        line("current_work", "current: "),
        line("context", "context: "),
        F.concat(F.lit("(covers "), c["covers_items"].cast("string"), F.lit(" earlier records)")),
    )


def parse_card(text: str | Column, marker: str = fixed.CARD_MARKER) -> Column:
    """A rendered card as a struct; NULL when the text does not start with the marker."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.split(text, r"\r?\n")
    rows = F.slice(whole, F.lit(2), F.size(whole) - 1)

    def entries(prefix: str) -> Column:
        found = F.filter(rows, lambda r: F.startswith(r, F.lit(prefix)))
        return F.transform(found, lambda r: r.substr(F.lit(len(prefix) + 1), F.length(r)))

    def last(prefix: str) -> Column:
        return F.try_element_at(entries(prefix), F.lit(-1))

    covers = F.filter(rows, lambda r: r.rlike(r"^\(covers \d+ earlier records\)$"))
    parsed = F.struct(
        last("goal: ").alias("goal"),
        last("summary: ").alias("summary"),
        entries("concept: ").alias("concepts"),
        entries("file: ").alias("files_touched"),
        entries("decision: ").alias("decisions"),
        entries("error: ").alias("errors"),
        entries("todo: ").alias("open_tasks"),
        last("current: ").alias("current_work"),
        last("context: ").alias("context"),
        F.coalesce(
            F.regexp_extract(F.try_element_at(covers, F.lit(-1)), r"(\d+)", 1).cast("long"),
            F.lit(0),
        ).alias("covers_items"),
    )
    return F.when(F.startswith(text, F.lit(marker)), parsed)
