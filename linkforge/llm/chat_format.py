"""Preference formatting: the longest common turn prefix of two conversations is the prompt, what follows are the completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id_col, turns)``: each conversation's turns by number, then role and text; null roles and texts are empty, null ids are left out.

    A conversation is one row, as it is one training example; rows equal in all four columns count once.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    one = F.struct(F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    listed = turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.array_sort(F.collect_set(one)).alias("turns"))
    return listed.select(id_col, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def render(turns) -> F.Column:
    """The turns in the ChatML template; markers inside texts are broken up by a blank."""
    safe = lambda s: F.replace(s, F.lit("<|im_"), F.lit("<| im_"))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(END))), "")


def trained_spans(turns) -> F.Column:
    """Character spans ``from-to`` of the rendered turns that count in the loss: assistants' texts with their end marker."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, turn):
        whole = F.length(render(F.array(turn))).cast("long")
        head = F.length(F.replace(turn["role"], F.lit("<|im_"), F.lit("<| im_"))) + len(START) + 1
        span = F.concat((acc["at"] + head).cast("string"), F.lit("-"), (acc["at"] + whole).cast("string"))
        spans = F.when(turn["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + whole).alias("at"), spans.alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def common_prefix(left, right) -> F.Column:
    """Number of leading turns that are equal in role and text."""
    both = F.least(F.size(left), F.size(right))
    count = lambda n, i: F.when((n == i - 1) & (F.element_at(left, i) == F.element_at(right, i)), i).otherwise(n)
    return F.when(both == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), F.lit(0), count))


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", carry: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """``carry`` with ``prefix_turns, prompt, chosen, rejected, chosen_spans, rejected_spans`` of every pair.

    ``chosen`` and ``rejected`` are arrays of (role, text); null ones are empty. The prompt carries no loss;
    a completion's loss covers its spans. Equal conversations have empty completions, and so no spans.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(*carry, F.coalesce(F.col(chosen), none).alias("_c"), F.coalesce(F.col(rejected), none).alias("_r")).withColumn("prefix_turns", common_prefix(F.col("_c"), F.col("_r")))
    rest = lambda c: F.slice(F.col(c), F.col("prefix_turns") + 1, F.greatest(F.size(c) - F.col("prefix_turns"), F.lit(0)))
    rows = rows.select(*carry, "prefix_turns", F.slice("_c", F.lit(1), F.col("prefix_turns")).alias("_p"), rest("_c").alias("_c"), rest("_r").alias("_r"))
    return rows.select(*carry, "prefix_turns", render(F.col("_p")).alias("prompt"), render(F.col("_c")).alias("chosen"), render(F.col("_r")).alias("rejected"), trained_spans(F.col("_c")).alias("chosen_spans"), trained_spans(F.col("_r")).alias("rejected_spans"))


def swapped_replies(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 1024) -> DataFrame:
    """Preference pairs ``(id_col, rejected_id, chosen, rejected)``, one for each conversation with an assistant turn, for tables that hold none.

    Chosen is the conversation up to its last assistant turn. Rejected goes off it at its assistant turn number
    id mod (assistant turns), from 0 on: there and from there on it has the turns of the neighbour, from the neighbour's
    assistant turn of that number, or its last if it has fewer, up to its last one. So pairs part early or late, and either
    side may be longer. The neighbour is the next larger id of the same remainder by the number of groups, the largest id's is the smallest: there is a
    group for each ``group`` conversations, so no task orders all ids. A conversation alone in its group is its own neighbour.
    """
    convs = conversations(turns, id_col, turn_col, role_col, text_col)
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda i: i.isNotNull())
    convs = convs.withColumn("_at", replies).where(F.size("_at") > 0).select(id_col, F.slice("turns", F.lit(1), F.element_at("_at", -1)).alias("chosen"), "_at")
    ids = convs.select(F.col(id_col).cast("long").alias("id"))
    groups = max(1, ids.count() // group)
    ids = ids.withColumn("g", F.pmod("id", F.lit(groups)))
    ids = ids.select("id", F.expr("coalesce(lead(id) over (partition by g order by id), min(id) over (partition by g))").alias("rejected_id"))
    other = convs.select(F.col(id_col).cast("long").alias("rejected_id"), F.col("chosen").alias("_other"), F.col("_at").alias("_theirs"))
    pairs = convs.join(ids, F.col(id_col).cast("long") == F.col("id")).join(other, "rejected_id")
    pairs = pairs.withColumn("_n", F.pmod("id", F.size("_at")).cast("int") + 1)
    pairs = pairs.withColumns({"_from": F.element_at("_at", F.col("_n")), "_their": F.element_at("_theirs", F.least(F.col("_n"), F.size("_theirs")))})
    rejected = F.concat(F.slice("chosen", F.lit(1), F.col("_from") - 1), F.slice("_other", F.col("_their"), F.size("_other")))
    return pairs.select(id_col, "rejected_id", "chosen", rejected.alias("rejected"))
