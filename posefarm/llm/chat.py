"""Chat logs to formatted training text.

A log is a table of events (conv_id, seq, kind, message, role, text):

    start       opens a message with a role
    delta       adds text to its message
    edit        replaces the message's text; later deltas add to it
    regenerate  empties the message, whose later deltas build it anew, and drops for good
                every message of the conversation that began between it and this event

Any other kind says nothing.  A message begins with its first event of any of these kinds and
has the first role that an event gives it.  ``folded`` brings a log, conversation by
conversation and in order of sequence, to its final messages; ``rendered`` writes those in a
template, and ``read_back`` takes the written text apart again.

The template is  [INST]role[/INST]text</s>  for every turn.  Control strings inside a role
or a text get a backslash after their first character, one more where there are some
already, so no control string of a text is ever one of the template, and taking one
backslash away gives the text back.  The loss mask is a list of [start, end) code points of
the formatted text: the assistant's texts.

The fold is made of aggregates and windows.  A message's text is gathered in one row;
a conversation never is: formatted texts come in parts of PART messages, numbered from 0,
and digests of several parts are streamed.

Cases: a null text or role is empty, a null seq comes first.  Events of equal seq are taken
by message, kind, role and text.  Rows that repeat are events (turns) of their own.  Rows
without a conv_id are one conversation, without a name.  A null message is a message of its
own name.  An empty log gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posefarm.functions.ordering import with_order
from posefarm.llm.digest import streamed_digests
from posefarm.llm.store import stored

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Pattern of a control string, whatever backslashes are in it already.
_CONTROL = r"([\[<])(\\*)(/?INST\]|/s>)"
_ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/s>)"
ASSISTANT = "assistant"
#: Messages of a formatted part, as a power of two.
PART_BITS = 10
#: Characters of a delta in a log made of whole turns.
DELTA = 1024
KINDS = ["start", "delta", "edit", "regenerate"]


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def as_log(turns: DataFrame) -> DataFrame:
    """The event log of turns (conv_id, place, role, text): a start, then the text in deltas."""
    step = F.sequence(F.lit(0), F.ceil(F.length("text") / DELTA).cast("int"))
    events = turns.select("conv_id", F.col("place").alias("message"), "role", "text", F.explode(step).alias("k"))
    first = F.col("k") == 0
    return events.select(
        "conv_id", (F.shiftleft("message", 24) + F.col("k")).alias("seq"), F.when(first, "start").otherwise("delta").alias("kind"), "message",
        F.when(first, F.col("role")).alias("role"), F.when(first, "").otherwise(F.substring("text", (F.col("k") - 1) * DELTA + 1, F.lit(DELTA))).alias("text"))


def folded(events: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text of the final messages of a log."""
    log = stored(events.filter(F.col("kind").isin(KINDS)).select(
        "conv_id", F.coalesce(F.col("seq").cast("long"), F.lit(-2**63)).alias("seq"), "kind", "message", "role",
        F.coalesce("text", F.lit("")).alias("text")), "log")
    key = ["conv_id", "message"]
    reset = F.col("kind").isin("edit", "regenerate")
    order = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("own"), "text")
    heads = log.groupBy(*key).agg(
        F.min("seq").alias("first"), F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "kind", "role"))).alias("r"),
        F.max(F.when(reset, order)).alias("from"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    heads = stored(heads.select(*key, "first", F.coalesce("r.role", F.lit("")).alias("role"), "from", "again"), "heads")

    # Dropped: some regeneration comes after a message's beginning and belongs to an earlier message.
    marks = heads.filter("again IS NOT NULL")
    touched = marks.select("conv_id").distinct()
    marked = heads.alias("h").join(touched.alias("t"), F.col("h.conv_id").eqNullSafe(F.col("t.conv_id")), "left_semi")
    both = marked.select(*key, F.col("first").alias("at"), F.lit(None).cast("long").alias("since"), F.lit(0).alias("is_mark")).unionByName(
        marks.select(*key, F.col("again").alias("at"), F.col("first").alias("since"), F.lit(1).alias("is_mark")))
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    gone = both.withColumn("since", F.min("since").over(later)).filter("is_mark = 0 AND since < at").select(*key)
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & F.col(f"{a}.message").eqNullSafe(F.col(f"{b}.message"))
    heads = heads.alias("h").join(gone.alias("g"), same("h", "g"), "left_anti")

    late = log.alias("e").join(heads.alias("h"), same("e", "h")).select(
        "h.conv_id", "h.message", "h.first", F.col("h.role"), F.col("h.from"), "e.seq", "e.kind", F.coalesce("e.role", F.lit("")).alias("own"), "e.text")
    counts = F.col("from").isNull() | (F.struct("seq", "kind", "own", "text") > F.col("from"))
    added = F.when((F.col("kind") == "delta") & counts, F.struct("seq", "own", "text"))
    messages = late.groupBy(*key).agg(
        F.min("first").alias("first"), F.min("role").alias("role"), F.max("from").alias("from"),
        F.array_sort(F.collect_list(added)).alias("added"))
    start = F.when(F.col("from.kind") == "edit", F.col("from.text")).otherwise("")
    messages = messages.select(*key, "first", "role", F.concat(start, F.array_join(F.transform("added", lambda a: a["text"]), "")).alias("text"))
    # The message's name settles equal beginnings; as text, so that any type has an order.
    named = messages.withColumn("_name", F.coalesce(F.col("message").cast("string"), F.lit(""))).withColumn("_long", F.length("_name"))
    return with_order(named, "conv_id", "first", ["_long", "_name"], rank="place").select("conv_id", "place", "role", "text")


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, part, text, loss (array of [start, end) in code points of the part's text)."""
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(CLOSE))
    body = escaped(F.col("text"))
    turns = messages.select("conv_id", "place", F.concat(head, body, F.lit(END)).alias("text"), F.length(head).alias("from"),
                            F.length(body).alias("long"), (F.col("role") == ASSISTANT).alias("learned"))
    parts = turns.groupBy("conv_id", F.shiftright(F.col("place") - 1, PART_BITS).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("place", "text", "from", "long", "learned"))).alias("turns"))
    at = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")),
                     lambda s, t: F.struct((s["at"] + F.length(t["text"])).alias("at"), F.when(t["learned"], F.concat(s["loss"], F.array(F.struct(
                         (s["at"] + t["from"]).alias("start"), (s["at"] + t["from"] + t["long"]).alias("end"))))).otherwise(s["loss"]).alias("loss")))
    return parts.select("conv_id", "part", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"), at["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, part, turns (array of role and text), learned (array of the texts under the
    mask), from formatted texts alone."""
    own = F.filter(F.split("text", END), lambda t: F.startswith(t, F.lit(OPEN)))
    parted = F.transform(own, lambda t: F.split(F.substring(t, len(OPEN) + 1, F.length(t)), r"\[/INST\]"))
    turns = F.transform(parted, lambda t: F.struct(unescaped(t[0]).alias("role"), unescaped(t[1]).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "part", turns.alias("turns"), learned.alias("learned"), F.length("text").cast("long").alias("chars"))


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text of turns, in order of turn (null first), then role and text."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-2**63)).alias("_turn"),
        F.col("turn").isNotNull().alias("_known"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return with_order(rows, "conv_id", "_turn", ["_known", "role", "text"], rank="place").select("conv_id", "place", "role", "text")


def summaries(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of written parts.

    A part is parsed once; only conversations of several parts are parsed again, for their
    digests run on from part to part.
    """
    parts = read_back(formatted).select(
        "conv_id", F.col("part").alias("run"), F.size("turns").cast("long").alias("n_turns"), "chars",
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns_sha256"),
        F.array_join("learned", "").alias("loss_sha256"))
    texts = ["turns_sha256", "loss_sha256"]
    own = stored(parts.select("conv_id", "run", "n_turns", "chars", F.length("loss_sha256").cast("long").alias("loss_chars"),
                              *[F.sha2(t, 256).alias(t) for t in texts]), "read")
    sums = own.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n_turns").alias("n_turns"), F.sum("loss_chars").alias("loss_chars"),
        F.sum("chars").alias("formatted_chars"), *[F.max(t).alias(t) for t in texts])
    out = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    long = stored(sums.filter("parts > 1").drop(*texts), "long")
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    several = parts.alias("p").join(long.select("conv_id").alias("l"), same("p", "l"), "left_semi")
    digests = streamed_digests(several, ["conv_id"], texts)
    met = long.alias("s").join(digests.alias("d"), same("s", "d")).select("s.conv_id", *out[1:])
    return sums.filter("parts = 1").select(out).unionByName(met)
