"""Quotation linking with column functions: conversations in reply order, without their quotes.

A line's quote level is the number of ``>`` at its front. Quoted lines, and the lines that
every message says itself, are normalised (case, white space) and hashed; quoted lines of one
level in a row are a passage. A passage belongs to the first message of its own conversation
that said all its lines in a row, or else to the first one in all conversations, if that stands
before the quoting message in the order (conv_id, turn). The lines of a passage that no message
said as a whole are looked for one by one in the same way, so that it is found however it was
cut. A message replies to the message that most of its level-1 lines belong to, the latest on a
tie; what n messages say counts one nth. Deeper levels are linked too, but do not decide.
Attribution lines ("On ... wrote:") right before a quote are dropped with it.

Only the first message per hash, and per hash and conversation, takes part in the joins, so a
line or passage that everyone says or quotes gives one row per quoted one, never pairs. Of what
messages say, only stretches that begin like a quoted passage and are as long are hashed. Reply links go
back in order, so they form trees; roots and depths are found by doubling. A tree belongs to
its root's conversation and is read by depth, then by (conv_id, turn); a message without a
link is a root. Ranks come from range-sorted parts and the parts' sizes, so a conversation may
be of any length.

Cases: null text is an empty message; rows with equal (conv_id, turn) form one message for the
links, and each row is given out; rows with null conv_id or turn have no links and come first;
blank and symbol-only lines are never matched; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetwright.llm.shared import bases, settled

KEY = ["conv_id", "turn"]
QUOTE = r"^[ \t]*(>[> \t]*)"
#: Vote of a line that one message says. A whole number, so that sums do not depend on their order.
WHOLE = 1 << 40
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*(?:wrote|schrieb|écrit|escribió)\s*:\s*$"


def with_lines(messages: DataFrame) -> DataFrame:
    """``messages`` with ``lines``: structs (level, text) of each line of ``text``."""

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, QUOTE, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(raw, QUOTE, "")).otherwise(raw).alias("text"))

    lines = F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n"), line)
    return messages.withColumn("lines", lines)


def _normal(text: Column) -> Column:
    """Normalised line; null where it has no letter or digit."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(plain.rlike(r"[\p{L}\p{N}]"), plain)


def with_hashes(messages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, own, passages): hashes of the lines that each message says itself, in order, and its
    quoted passages (level, hashes): lines of one level in a row. Blank lines do not count."""

    def hashed(line: Column) -> Column:
        return F.struct(line["level"].alias("level"), F.xxhash64(line["normal"]).alias("hash"))

    found = with_lines(messages).select(
        *KEY,
        F.transform("lines", lambda x: F.struct(x["level"].alias("level"), _normal(x["text"]).alias("normal"))).alias("lines"),
    )
    found = found.select(
        *KEY, F.transform(F.filter("lines", lambda x: x["normal"].isNotNull()), hashed).alias("lines")
    ).filter(F.size("lines") > 0)
    starts = """filter(sequence(0, size(lines) - 1), k -> k = 0 OR lines[k].level <> lines[greatest(k - 1, 0)].level)"""
    runs = """transform(starts, (at, k) -> named_struct('level', lines[at].level, 'hashes',
        transform(slice(lines, at + 1, coalesce(get(starts, k + 1), size(lines)) - at), x -> x.hash)))"""
    return found.withColumn("starts", F.expr(starts)).select(
        F.monotonically_increasing_id().alias("row"),
        *KEY,
        F.expr("transform(filter(lines, x -> x.level = 0), x -> x.hash)").alias("own"),
        F.filter(F.expr(runs), lambda x: x["level"] > 0).alias("passages"),
    )


def _sourced(quotes: DataFrame, here: DataFrame) -> DataFrame:
    """``quotes`` with the ``source`` of ``hash``, or null, and ``share``: WHOLE over the number of messages that say it.

    ``here`` has the first turn and the number of messages per hash and conversation.
    """
    first = here.groupBy("hash").agg(F.min(F.struct("conv_id", "here")).alias("first"), F.sum("n_here").alias("n_all"))
    before = F.col("here") < F.col("turn")
    elsewhere = F.col("first") < F.struct(F.col("conv_id"), F.col("turn").alias("here"))
    return (
        quotes.join(here, ["hash", "conv_id"], "left")
        .join(first, "hash", "left")
        .withColumn(
            "source",
            F.when(before, F.struct("conv_id", F.col("here").alias("turn"))).when(
                elsewhere, F.struct(F.col("first.conv_id").alias("conv_id"), F.col("first.here").alias("turn"))
            ),
        )
        .withColumn("share", F.expr(f"{WHOLE} div IF(here < turn, n_here, n_all)"))
        .drop("here", "n_here", "first", "n_all")
    )


def _first_said(said: DataFrame) -> DataFrame:
    return said.groupBy("hash", "conv_id").agg(F.min("turn").alias("here"), F.count("*").alias("n_here"))


def weighed_links(messages: DataFrame) -> DataFrame:
    """``quote_links`` with ``weight``: lines by their share."""
    hashed = settled(
        with_hashes(messages.select(*KEY, "text").filter("conv_id IS NOT NULL AND turn IS NOT NULL")), "quote-hashes"
    )
    quoted = hashed.select(*KEY, F.explode("passages").alias("passage")).select(
        *KEY, "passage.level", "passage.hashes", F.size("passage.hashes").alias("n")
    )
    passages = settled(quoted.withColumn("hash", F.xxhash64("hashes", "n")), "quotes")
    # Windows that may be a passage begin with its first line and are as long.
    sizes = F.collect_set(F.when(F.col("n") > 1, F.col("n"))).alias("sizes")
    begun = passages.filter("n > 1").groupBy(F.element_at("hashes", 1).alias("hash")).agg(sizes)
    wanted = passages.select(F.explode("hashes").alias("hash")).distinct().join(begun, "hash", "left")
    said = hashed.select("row", *KEY, F.posexplode("own").alias("at", "hash")).join(wanted, "hash")
    said = settled(said, "quote-said")
    begins = said.filter("sizes IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("at", "sizes")).alias("begins"))
    windows = """array_distinct(flatten(transform(begins, b -> transform(
        filter(b.sizes, n -> b.at + n <= size(own)), n -> xxhash64(slice(own, b.at + 1, n), n)))))"""
    whole = hashed.select("row", *KEY, "own").join(begins, "row").select(*KEY, F.explode(F.expr(windows)).alias("hash"))
    whole = whole.join(passages.filter("n > 1").select("hash").distinct(), "hash", "left_semi")
    found = settled(_sourced(passages, settled(_first_said(whole), "quote-wholes")), "quote-passages")
    lines = found.filter("source IS NULL").select(*KEY, "level", F.explode("hashes").alias("hash"), F.lit(1).alias("n"))
    once = said.select("row", *KEY, "hash").distinct()
    lines = _sourced(lines, settled(_first_said(once), "quote-origins"))
    columns = [*KEY, "level", "source", "n", "share"]
    linked = found.select(*columns).unionByName(lines.select(*columns)).filter("source IS NOT NULL")
    return linked.groupBy(*KEY, "level", "source").agg(
        F.sum("n").alias("n_lines"), F.sum(F.col("n") * F.col("share")).alias("weight")
    ).select(
        *KEY, "level", F.col("source.conv_id").alias("from_conv"), F.col("source.turn").alias("from_turn"), "n_lines", "weight"
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, from_conv, from_turn, n_lines): the passages of each message by their source."""
    return weighed_links(messages).drop("weight")


def reply_links(links: DataFrame) -> DataFrame:
    """(conv_id, turn, to_conv, to_turn): the message with the most weight of level-1 lines."""
    votes = links.filter("level = 1").groupBy(*KEY, "from_conv", "from_turn").agg(F.sum("weight").alias("n"))
    best = votes.groupBy(*KEY).agg(F.max(F.struct("n", "from_conv", "from_turn")).alias("best"))
    return best.select(*KEY, F.col("best.from_conv").alias("to_conv"), F.col("best.from_turn").alias("to_turn"))


def reply_trees(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of every message that replies, by doubling its way to the root."""
    paths = settled(
        replies.select(*KEY, F.col("to_conv").alias("root_conv"), F.col("to_turn").alias("root_turn"), F.lit(1).alias("depth")),
        "reply-trees",
    )
    while True:
        ahead = paths.select(
            F.col("conv_id").alias("root_conv"),
            F.col("turn").alias("root_turn"),
            F.struct("root_conv", "root_turn", "depth").alias("next"),
        )
        stepped = paths.join(ahead, ["root_conv", "root_turn"], "left")
        if stepped.filter("next IS NOT NULL").isEmpty():
            return paths
        paths = settled(
            stepped.select(
                *KEY,
                F.coalesce("next.root_conv", "root_conv").alias("root_conv"),
                F.coalesce("next.root_turn", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("next.depth", F.lit(0))).alias("depth"),
            ),
            "reply-trees",
        )


def without_quotes(lines: Column) -> Column:
    """The lines that a message says itself, without attributions that stand before a quote."""
    after = F.slice(F.concat(lines, F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("text")))), 2, F.size(lines))
    pairs = F.zip_with(lines, after, lambda a, b: F.struct(a.alias("own"), b["level"].alias("next")))
    kept = F.filter(
        pairs, lambda p: (p["own"]["level"] == 0) & ~((p["next"] > 0) & p["own"]["text"].rlike(ATTRIBUTION))
    )
    return F.trim(F.array_join(F.transform(kept, lambda p: p["own"]["text"]), "\n"))


def conversations(messages: DataFrame) -> DataFrame:
    """Every message row with its link, its place in its conversation's reply order, and its text without quotes.

    Columns: conv_id, turn, role, body, n_quoted (lines), reply_conv, reply_turn, thread_conv,
    root_turn, depth, position (from 0 in ``thread_conv``).
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    links = settled(weighed_links(rows), "quote-links")
    replies = settled(reply_links(links), "reply-links")
    trees = reply_trees(replies)
    placed = (
        with_lines(rows)
        .select(
            *KEY,
            "role",
            without_quotes(F.col("lines")).alias("body"),
            F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"),
        )
        .join(replies, KEY, "left")
        .join(trees, KEY, "left")
        .select(
            *KEY,
            "role",
            "body",
            "n_quoted",
            F.col("to_conv").alias("reply_conv"),
            F.col("to_turn").alias("reply_turn"),
            F.coalesce("root_conv", "conv_id").alias("thread_conv"),
            F.coalesce("root_turn", "turn").alias("root_turn"),
            F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        )
    )
    order = ["thread_conv", "root_turn", "depth", *KEY, "role", "body"]
    sorted_rows = placed.repartitionByRange(*order[:5]).withColumn("_part", F.spark_partition_id())
    sorted_rows = settled(sorted_rows, "conversations")
    # Parts are of like size, whatever conversation they hold; ranks in a part and the parts' sizes give the rest.
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = sorted_rows.withColumn("_inner", inner).join(
        bases(sorted_rows.withColumn("_one", F.lit(1)), "_part", "_one"), "_part"
    )
    ranked = ranked.withColumn("_rank", F.col("base") + F.col("_inner"))
    sizes = sorted_rows.groupBy("_part", "thread_conv").agg(F.count("*").alias("n"))
    first = sizes.withColumn(
        "_before",
        F.coalesce(
            F.sum("n").over(Window.partitionBy("_part").orderBy("thread_conv").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).join(bases(sizes, "_part", "n"), "_part")
    first = first.groupBy(F.col("thread_conv").alias("_thread")).agg(
        F.min(F.col("base") + F.col("_before")).alias("_first")
    )
    return ranked.join(first, F.col("thread_conv").eqNullSafe(F.col("_thread"))).select(
        *KEY, "role", "body", "n_quoted", "reply_conv", "reply_turn", "thread_conv", "root_turn", "depth",
        (F.col("_rank") - F.col("_first")).alias("position"),
    )
