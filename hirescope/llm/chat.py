"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts of type text, image, audio or document (a
plain text column is one text part). Parts are flattened in order: texts are
escaped, other parts become one placeholder each, whose reference, place and
expanded token count (units times tokens per unit of its kind) are recorded. A
turn is ``<|im_start|>role``, a line break, the content, ``<|im_end|>`` and a line
break. Escaping doubles backslashes and puts one into every ``<|``, so control
strings appear only where the template writes them and every text can be read
back. The loss mask marks the content of assistant turns.

A conversation is one text by nature, so its turns meet in one row; offsets come
from a running sum, not from a fold over the list.

Cases: null text or role is empty; turns are ordered by number (null first), then
role, text and escaped content; repeated rows are repeated turns; a null conv_id is a conversation;
unknown kinds of part count as documents; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLES = ("assistant",)
#: Tokens that a model spends on one unit: a tile of an image, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _kind(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["kind"], F.lit("text")))
    return F.when(kind.isin("text", *UNIT_TOKENS), kind).otherwise("document")


def _placeholder(part: Column) -> Column:
    flat = F.coalesce(escaped(part["text"]), F.lit(""))
    return F.when(_kind(part) == "text", flat).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def _tokens(part: Column) -> Column:
    units = F.coalesce(part["units"].cast("long"), F.lit(1))
    per = F.lit(UNIT_TOKENS["document"])
    for kind, n in UNIT_TOKENS.items():
        per = F.when(_kind(part) == kind, F.lit(n)).otherwise(per)
    return units * per


def flatten(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> escaped head and content per turn, its plain text, and its attachments.

    An array column ``parts`` of struct (kind, text, ref, units) takes the place of
    ``text`` where it is not null.
    """
    plain = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"),
                             F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))
    parts = plain
    if "parts" in turns.columns:
        given = F.transform("parts", lambda p: F.struct(
            p["kind"].cast("string").alias("kind"), p["text"].cast("string").alias("text"),
            p["ref"].cast("string").alias("ref"), p["units"].cast("long").alias("units")))
        parts = F.coalesce(given, plain)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), parts.alias("_parts"))
    return rows.select(
        "conv_id", "turn", "role",
        F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n")).alias("head"),
        F.array_join(F.transform("_parts", _placeholder), "").alias("content"),
        F.array_join(F.transform("_parts", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("said"),
        F.transform(F.filter("_parts", lambda p: _kind(p) != "text"),
                    lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attachments"))


def format_chat(turns: DataFrame) -> DataFrame:
    """Per conversation: formatted, spans (of each turn: its start, content start and length,
    whether loss applies) and attachments (turn place, kind, ref, tokens) in order."""
    flat = flatten(turns).withColumn("_size", F.length("head") + F.length("content") + len(END) + 1)
    running = Window.partitionBy("conv_id").orderBy("turn", "role", "said", "content").rowsBetween(Window.unboundedPreceding, 0)
    flat = (flat.withColumn("_end", F.sum(F.col("_size").cast("long")).over(running))
            .withColumn("_place", F.count(F.lit(1)).over(running) - 1))
    start = F.col("_end") - F.col("_size")
    turn = F.struct(
        F.col("_place").alias("place"), start.alias("turn_start"), (start + F.length("head")).alias("start"),
        F.length("content").cast("long").alias("length"), F.col("role").isin(*LOSS_ROLES).alias("loss"),
        F.concat("head", "content", F.lit(END + "\n")).alias("text"), F.col("attachments"))
    grouped = flat.select("conv_id", turn.alias("_turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    return grouped.select(
        "conv_id", F.array_join(F.transform("_turns", lambda t: t["text"]), "").alias("formatted"),
        F.transform("_turns", lambda t: F.struct(t["turn_start"].alias("turn_start"), t["start"].alias("start"),
                                                 t["length"].alias("length"), t["loss"].alias("loss"))).alias("spans"),
        F.flatten(F.transform("_turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(
            t["place"].alias("turn_place"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns (role, text) and the text under the loss mask, from formatted and spans alone."""
    segments = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.size("spans"))

    def turn(seg: Column) -> Column:
        role = F.substring_index(seg, "\n", 1)
        rest = F.length(seg) - F.length(role) - 1 - len(END) - 1
        return F.struct(unescaped(F.replace(role, F.lit(NEWLINE), F.lit("\n"))).alias("role"),
                        unescaped(F.substr(seg, F.length(role) + 2, rest)).alias("text"))

    def masked(seg: Column, span: Column) -> Column:
        at = (span["start"] - span["turn_start"] - len(START) + 1).cast("int")
        return F.when(span["loss"], unescaped(F.substr(seg, at, span["length"].cast("int")))).otherwise("")

    return formatted.withColumn("_segments", segments).withColumns({
        "turns": F.transform("_segments", turn),
        "loss_text": F.array_join(F.zip_with("_segments", "spans", masked), "")}).drop("_segments")


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back."""
    back = read_back(format_chat(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
