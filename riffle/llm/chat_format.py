"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<s>" role flag "[INST]" text "[/INST]</s>"

`flag` is empty, or a backslash for a turn whose role and text are escaped. Parsing is deterministic: a turn ends at the first
"</s>", its role at the first "[INST]", its text before the last "[/INST]". A turn is first rendered as it is and parsed
again; if that does not give back role and text exactly, or if either holds a control string, it is escaped (each backslash
doubled, and a backslash put after each "<" and "[", so that no control string is left) and parsed again. The
whole conversation is then parsed from its rendering and compared to the source; a difference, which cannot occur, would
stop the query. The loss mask is part of the output: the places of assistant texts in the rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BODY, CLOSE, END, FLAG = "<s>", "[INST]", "[/INST]", "</s>", "\\"
CONTROLS = (OPEN, BODY, CLOSE, END)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def _render(role: Column, text: Column, flag: str) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(flag + BODY), text, F.lit(CLOSE + END))


def parse_turn(turn: Column) -> Column:
    """(role, text, start, length, escaped) of one rendered turn without its END; start and length are those of the text as it stands there, in code points; null if it is no turn."""
    inner = F.substring(turn, len(OPEN) + 1, 1 << 30)
    head = F.substring_index(inner, BODY, 1)
    body = F.substr(inner, F.length(head) + len(BODY) + 1)
    text = F.substr(body, F.lit(1), F.length(body) - len(CLOSE))
    escaped = F.endswith(head, F.lit(FLAG))
    role = F.when(escaped, unescape(F.substr(head, F.lit(1), F.length(head) - 1))).otherwise(head)
    whole = F.startswith(turn, F.lit(OPEN)) & F.contains(inner, F.lit(BODY)) & F.endswith(body, F.lit(CLOSE))
    start = F.length(head) + len(OPEN) + len(BODY)
    return F.when(whole, F.struct(role.alias("role"), F.when(escaped, unescape(text)).otherwise(text).alias("text"), start.alias("start"), F.length(text).alias("length"), escaped.alias("escaped")))


def parse(formatted: Column) -> Column:
    """All turns of a rendering, in order."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), parse_turn)


def render_turn(role: Column, text: Column) -> Column:
    """A turn's rendering: escaped if role or text has a control string, or if the plain one does not parse back to both."""
    plain = _render(role, text, "")
    first = parse_turn(F.substring_index(plain, END, 1))
    same = (first["role"] == role) & (first["text"] == text)
    for c in CONTROLS:
        same = same & ~F.contains(role, F.lit(c)) & ~F.contains(text, F.lit(c))
    return F.when(F.coalesce(same, F.lit(False)), plain).otherwise(_render(escape(role), escape(text), FLAG))


def format_conversations(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row for each conversation: key, formatted, turns (role, text), loss (part, base, start, end, escaped).

    turns are parsed from formatted. loss is the mask: for each assistant turn the number of its part of the rendering, where
    that part begins, and start and end of its text in the rendering, in code points; escaped as it stands there or not.
    Rows go by turn, null turns last, ties by role and text; repeated rows are turns of their own; null role or text reads
    as empty. A row with a null key belongs to no conversation: it is one by itself, with a null key. A conversation is one
    text, so that its turns meet in one task. Other columns are left out; an empty table gives no rows.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    clean = rows.select(F.col(key).alias("__c"), F.col("turn").isNull().alias("__late"), F.col("turn").alias("__turn"), role.alias("__role"), text.alias("__text"))
    pieces = clean.withColumn("__piece", render_turn(F.col("__role"), F.col("__text")))
    # where each turn begins in its conversation; the group after it has the same partitioning
    before = Window.partitionBy("__c").orderBy("__late", "__turn", "__role", "__text").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.where("__c is not null").withColumn("__at", F.coalesce(F.sum(F.length("__piece")).over(before), F.lit(0).cast("long")))
    row = F.struct("__late", "__turn", "__role", "__text", "__at", "__piece")
    whole = placed.groupBy("__c").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    alone = pieces.where("__c is null").withColumn("__at", F.lit(0).cast("long")).select("__c", F.array(row).alias("__rows"))
    whole = whole.union(alone).withColumn("formatted", F.array_join(F.transform("__rows", lambda r: r["__piece"]), ""))
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    # identical in number, roles and texts
    source = F.transform("__rows", lambda r: F.struct(r["__role"].alias("role"), r["__text"].alias("text")))
    parsed = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(source == parsed, F.col("formatted")).otherwise(F.raise_error(F.lit("a rendering does not parse back")).cast("string"))
    base = lambda i: F.get("__rows", i)["__at"]
    span = lambda t, i: F.struct(i.alias("part"), base(i).alias("base"), (base(i) + t["start"]).alias("start"), (base(i) + t["start"] + t["length"]).alias("end"), t["escaped"].alias("escaped"), t["role"].alias("role"))
    mask = F.transform(F.filter(F.transform("turns", span), lambda x: x["role"] == "assistant"), lambda x: x.dropFields("role"))
    return whole.select(F.col("__c").alias(key), checked.alias("formatted"), parsed.alias("turns"), mask.alias("loss"))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, cut out of the rendering and unescaped. Spans are cut from their parts, so that a long conversation is not counted through for each."""
    parts = F.split(formatted, END, -1)
    cut = lambda x: F.substr(F.get(parts, x["part"]), (x["start"] - x["base"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
    return F.array_join(F.transform(loss, lambda x: F.when(x["escaped"], unescape(cut(x))).otherwise(cut(x))), "")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """n_turns, hashes and lengths of the turns and of the text under the loss mask (assistant texts), read back from the rendering."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("__loss", masked_text(F.col("formatted"), F.col("loss"))).select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
