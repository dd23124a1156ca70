r"""Reply trees to formatted conversations, with built-in DataFrame functions only.

Messages name the message they answer. Iterative self-joins enumerate the paths from roots to leaves: the k-th round joins
each message to the one 2**k above it, and each leaf's known path to what lies 2**k above it, so a chain of n messages takes
log2(n) rounds. Branches are ranked by score within their tree, and each chosen path becomes one conversation.

The template, with control strings `<s> </s> [INST] [/INST] <<SYS>> <</SYS>> [ROLE] [/ROLE]`:

    <s>                          begins a conversation
    <<SYS>>text<</SYS>>          a system turn
    [INST] text [/INST]          a user turn
    ` text</s>`                  an assistant turn; its text is under the loss mask
    [ROLE] name [/ROLE] text</s> a turn of any other role

Inside texts and names a backslash goes in after the first character of a control string, and one more where backslashes
already stand there. So no control string is left in them, and taking one away again restores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import checkpoint

_ESCAPE = r"(<)(?=\\*(?:/?s>|</?SYS>>))|(\[)(?=\\*/?(?:INST|ROLE)\])"
_UNESCAPE = r"(<)\\(?=\\*(?:/?s>|</?SYS>>))|(\[)\\(?=\\*/?(?:INST|ROLE)\])"
_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\] .*? \[/INST\]|\[ROLE\] .*?</s>| .*?</s>"
_ROLE = r"(?s)^\[ROLE\] (.*?) \[/ROLE\] "


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """What stands before, in and after a turn's escaped text."""
    other = F.concat(F.lit("[ROLE] "), escape(role), F.lit(" [/ROLE] "))
    before = F.when(role == "system", "<<SYS>>").when(role == "user", "[INST] ").when(role == "assistant", " ").otherwise(other)
    after = F.when(role == "system", "<</SYS>>").when(role == "user", " [/INST]").otherwise("</s>")
    return before, escape(text), after


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of numbered turns as messages (tree, id, parent, role, text, score): each answers the turn before it.

    Of equal or null numbers (which come first) the role and then the text decide; rows with a null conversation are one.
    A null role or text is the empty one. A chain is one row in the end, so a window over it is no larger than that row.
    """
    from pyspark.sql import Window as W

    r = rows.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text"))
    named = lambda n: F.struct(F.col("tree").isNull().alias("none"), F.coalesce(F.col("tree").cast("string"), F.lit("")).alias("tree"), n.alias("place"))
    return r.withColumn("place", place).select("tree", named(F.col("place")).alias("id"), F.when(F.col("place") > 1, named(F.col("place") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """(leaf, up, id): for every message without an answer, itself (up 0) and all above it, up to its root.

    A message that answers itself, none or a missing one is a root. Messages of a cycle, and those below one, have no root and
    get no path. Ids are unique; null ones are left out. Every round joins on ids, of which one side has each once, so a
    message with very many answers makes a skewed join, not a large group.
    """
    m = messages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"))
    ids = m.select(F.col("id").alias("up"))
    links = checkpoint(m.where("id <> up").join(ids, "up", "left_semi").select("id", "up"))
    jumps, total, far = [], links.count(), 1
    jump = links
    while far <= total and jump.limit(1).count():
        jumps.append(jump)
        jump = checkpoint(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("above")), "up").select("id", F.col("above").alias("up")))
        far *= 2
    leaves = m.select("id").join(links.select(F.col("up").alias("id")), "id", "left_anti")
    if far > total:  # no path is longer than all links, so what still jumps goes round a cycle
        leaves = leaves.join(jump.select("id"), "id", "left_anti")
    out = checkpoint(leaves.select(F.col("id").alias("leaf"), F.lit(0).cast("bigint").alias("up"), "id"))
    for k, jump in enumerate(jumps):
        more = out.join(jump.withColumnRenamed("up", "above"), "id").select("leaf", (F.col("up") + (1 << k)).alias("up"), F.col("above").alias("id"))
        out = out.unionByName(checkpoint(more))
    return out


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, branch, score, text, loss): each path from a root to a leaf as one conversation, by the template above.

    messages has tree, id, parent, role, text and score. A branch's score is the sum of its messages' (null: 0), and branch is
    its place in its tree, from 1, by score, highest first (ties: by leaf); with best only so many branches of a tree are
    formatted, without it all are and are not ranked (branch is null). loss lists the spans (start, end) of the assistants'
    escaped texts, in code points. An empty table gives no rows.
    """
    from pyspark.sql import Window as W

    messages = checkpoint(
        messages.select("tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    )
    way = paths(messages).withColumn("branch", F.lit(None).cast("int"))
    if best is not None:
        total = way.join(messages.select("tree", "id", "score"), "id").groupBy("leaf").agg(F.sum("score").alias("score"), F.max(F.when(F.col("up") == 0, F.struct("tree"))).alias("t"))
        place = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
        chosen = total.select("leaf", "score", F.col("t.tree").alias("tree")).withColumn("branch", place).where(F.col("branch") <= best)
        way = way.drop("branch").join(chosen.select("leaf", "branch"), "leaf")
    before, text, after = turn(F.col("role"), F.col("text"))
    each = way.join(messages, "id").select("leaf", "up", "tree", "branch", "score", before.alias("before"), text.alias("text"), after.alias("after"), (F.col("role") == "assistant").alias("loss"))
    size = F.char_length("before") + F.char_length("text") + F.char_length("after")
    upto = F.sum(size.cast("bigint")).over(W.partitionBy("leaf").orderBy(F.desc("up")))
    end = F.lit(3) + upto - F.char_length("after")
    span = F.struct((end - F.char_length("text")).alias("start"), end.alias("end"))
    parts = F.struct((-F.col("up")).alias("place"), F.concat("before", "text", "after").alias("text"), "loss", span.alias("span"))
    whole = each.withColumn("part", parts).groupBy("leaf").agg(
        F.max(F.when(F.col("up") == 0, F.struct("tree"))).alias("t"), F.max("branch").alias("branch"), F.sum("score").alias("score"), F.array_sort(F.collect_list("part")).alias("turns")
    )
    loss = F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["span"])
    text = F.concat(F.lit("<s>"), F.array_join("turns.text", ""))
    return whole.select(F.col("t.tree").alias("tree"), "leaf", "branch", "score", text.alias("text"), loss.alias("loss"))


def parse(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.regexp_extract_all(F.substr(text, F.lit(4)), F.lit(_TURN), F.lit(0))
    cut = lambda p, a, b: F.substr(p, F.lit(a + 1), F.char_length(p) - (a + b))
    role = lambda p: F.regexp_extract(p, _ROLE, 1)
    return F.transform(
        pieces,
        lambda p: F.when(p.startswith("<<SYS>>"), F.struct(F.lit("system").alias("role"), unescape(cut(p, 7, 8)).alias("text")))
        .when(p.startswith("[INST]"), F.struct(F.lit("user").alias("role"), unescape(cut(p, 7, 8)).alias("text")))
        .when(p.startswith("[ROLE]"), F.struct(unescape(role(p)).alias("role"), unescape(F.substr(p, F.char_length(role(p)) + 17, F.char_length(p) - F.char_length(role(p)) - 20)).alias("text")))
        .otherwise(F.struct(F.lit("assistant").alias("role"), unescape(cut(p, 1, 4)).alias("text"))),
    )


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per formatted conversation (tree, text, loss) what is read back from it: id, n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars. Texts under the mask are taken from their spans, not from the parsed turns."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss", lambda x: unescape(F.substr("text", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")
    read = formatted.select("tree", "text", parse(F.col("text")).alias("turns"), under.alias("under"))
    return read.select(
        F.col("tree").alias(id_col),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("under").cast("bigint").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.char_length("text").cast("bigint").alias("formatted_chars"),
    )
