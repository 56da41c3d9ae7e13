"""Chat formatting: turns to one marked text per conversation, Spark expressions only.

Turns are collected as structs, sorted, adjacent turns of one role merged by array
functions in time linear in the turns, and concatenated. The template:

    system     <<SYS>>text<</SYS>>
    user       [INST]text[/INST]
    assistant  <s>text</s>            the text is under the loss mask
    others     <|role|>text</|>

Merged turns stand between one pair of marks, joined by ``<+>``. Inside texts
and role names, backslash, ``<`` and ``[`` are written ``\\-``, ``\\(`` and ``\\{``
(in role names also ``|`` as ``\\!``), so that in the whole output ``<`` and ``[``
only ever begin a mark, and reading back is exact.

Defined results: NULL texts and roles are empty; equal turn numbers are ordered
by role, then text; NULL turns come first; repeated rows are turns of their own;
a NULL conv_id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before and after each role's text; other roles have OTHER.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|", "|>", "</|>")
JOINT = "<+>"
LOSS_ROLE = "assistant"
ESCAPES = (("\\", "\\-"), ("<", "\\("), ("[", "\\{"))
ROLE_ESCAPES = (*ESCAPES, ("|", "\\!"))


def escape(c: Column, escapes=ESCAPES) -> Column:
    for plain, written in escapes:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, escapes=ESCAPES) -> Column:
    for plain, written in reversed(escapes):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def _mark(role: Column, end: int) -> Column:
    other = F.concat(F.lit(OTHER[0]), escape(role, ROLE_ESCAPES), F.lit(OTHER[1])) if end == 0 else F.lit(OTHER[2])
    out = F.when(role == list(MARKS)[0], F.lit(list(MARKS.values())[0][end]))
    for name, marks in list(MARKS.items())[1:]:
        out = out.when(role == name, F.lit(marks[end]))
    return out.otherwise(other)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, segments (text, in_loss) and formatted, their concatenation.

    ``segments`` cut the output at the borders of the loss mask and of the
    turns; ``loss_spans`` are the (start, length) of those under the mask, in
    code points.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    # a block begins where the role differs from that of the turn before; every step is linear in the turns
    n = F.size("turns")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    marked = turns.withColumn("begins", begins)
    blocks = marked.select("conv_id", F.transform("begins", lambda i, k: F.struct(
        F.get("turns", i)["role"].alias("role"),
        F.slice("turns", i + 1, F.coalesce(F.get("begins", k + 1), n) - i)["text"].alias("texts"))).alias("blocks"))

    def segment(text: Column, in_loss: Column) -> Column:
        return F.struct(text.alias("text"), in_loss.alias("in_loss"))

    def written(b: Column) -> Column:
        inner = F.transform(b["texts"], lambda t, i: F.array(
            segment(F.when(i > 0, F.lit(JOINT)).otherwise(F.lit("")), F.lit(False)),
            segment(escape(t), b["role"] == LOSS_ROLE)))
        return F.concat(F.array(segment(_mark(b["role"], 0), F.lit(False))), F.flatten(inner),
                        F.array(segment(_mark(b["role"], 1), F.lit(False))))

    out = blocks.select("conv_id", F.filter(F.flatten(F.transform("blocks", written)),
                                            lambda s: s["in_loss"] | (s["text"] != "")).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def loss_spans(segments: Column, chunk: int = 128) -> Column:
    """(start, length) in code points of the segments under the loss mask.

    Starts are sums within chunks of segments on top of sums of whole chunks, so that no
    array grows turn by turn.
    """
    sizes = F.transform(segments, lambda s: F.length(s["text"]).cast("long"))
    zero = F.lit(0).cast("long")

    def total(at: Column, n: Column) -> Column:
        return F.aggregate(F.slice(sizes, at + 1, n), zero, lambda a, x: a + x)

    chunks = F.sequence(F.lit(0), F.floor(F.size(segments) / chunk).cast("int"))
    before = F.aggregate(F.transform(chunks, lambda c: total(c * chunk, F.lit(chunk))), F.array(zero),
                         lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    cut = F.struct(before.alias("before"), sizes.alias("sizes"))
    # the two lists are made once: they are the single element that the lambda is called on
    spans = F.element_at(F.transform(F.array(cut), lambda c: F.transform(segments, lambda s, i: F.struct(
        s["in_loss"].alias("in_loss"),
        (F.get(c["before"], F.floor(i / chunk).cast("int"))
         + F.aggregate(F.slice(c["sizes"], F.floor(i / chunk).cast("int") * chunk + 1, i % chunk), zero, lambda a, x: a + x)).alias("start"),
        F.get(c["sizes"], i).alias("length")))), 1)
    return F.transform(F.filter(spans, lambda s: s["in_loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask of a formatted conversation, read back from its marks and unescaped.

    In the output ``<`` only ever begins a mark, so the text under the mask is
    what stands between the loss role's marks, without joints.
    """
    start, end = MARKS[LOSS_ROLE]
    parts = F.split(formatted, f"\\Q{end}\\E")
    masked = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring_index(p, start, -1))
    return F.array_join(F.transform(masked, lambda p: unescape(F.replace(p, F.lit(JOINT), F.lit("")))), "")


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, read back from its marks."""
    ends = "|".join([*(f"\\Q{marks[1]}\\E" for marks in MARKS.values()), f"\\Q{OTHER[2]}\\E"])
    blocks = F.filter(F.split(formatted, ends), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.when(b.startswith(OTHER[0]), unescape(F.regexp_extract(b, r"^<\|([^|]*)\|>", 1), ROLE_ESCAPES))
        rest = F.when(b.startswith(OTHER[0]), F.regexp_replace(b, r"^<\|[^|]*\|>", ""))
        for name, (start, _) in MARKS.items():
            role = role.when(b.startswith(start), F.lit(name))
            rest = rest.when(b.startswith(start), F.substring(b, F.lit(len(start) + 1), F.length(b)))
        return F.transform(F.split(rest, f"\\Q{JOINT}\\E"),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output alone: turns, loss text and lengths, as digests."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            loss_text(F.col("formatted")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
