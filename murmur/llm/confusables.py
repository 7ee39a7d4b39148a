"""Visually identical text with different characters.

The skeleton of a text: decompose it canonically, replace every character by its prototype from a look-alike table,
decompose again. Texts with equal skeletons look the same.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letters that they look like, from the public Unicode table of confusables.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "һ": "h", "ո": "n", "ց": "g", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʋ": "u", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
del LOOK_ALIKES["σ"]  # sigma has a shape of its own in running text


def _table() -> dict[int, str]:
    """Code point to prototype, by rule but for the letters above."""
    table = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for code in (*range(0x20000), *range(0xE0000, 0xE1000)):  # all other planes hold nothing of the kind
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" and code < 0xE0100 or 0xFE00 <= code <= 0xFE0F or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= code <= 0x180F or 0xE0000 <= code <= 0xE0FFF:
            table[code] = ""  # invisible
        elif kind == "Zs" and code != 0x20:
            table[code] = " "  # spaces of other widths
        elif kind[0] in "LNPS" and code > 0x7F:
            form = unicodedata.decomposition(char)
            if form.startswith(("<wide>", "<narrow>", "<font>")) or (form.startswith("<compat>") and kind[0] == "L" and len(form.split()) > 2):
                table[code] = unicodedata.normalize("NFKD", char)  # full- and half-width forms, styled letters, joined letters
    return table


TABLE = _table()
#: Characters that the table may replace; texts without any, most of them, are only decomposed. Those beyond the basic
#: plane are looked for by their range, as a class that names them one by one is searched slowly.
_BASIC = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(TABLE) if c < 0x10000) + "]").search
_BEYOND = re.compile("[\U00010000-\U0010FFFF]").search


def replaceable(text: str) -> bool:
    """Whether the table replaces any character of the text, or may do so."""
    return bool(_BASIC(text) or _BEYOND(text))


def skeleton(text: str | None) -> str | None:
    """The one form of all texts that look like this one; null stays null, and a text of invisible characters becomes empty."""
    if text is None or text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", text.translate(TABLE)) if replaceable(text) else text


def shown(text: str | None) -> str | None:
    """The skeleton with composed accents, as a reader would write it."""
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", skeleton(text))


@F.pandas_udf(T.StringType())
def skeleton_column(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def with_skeleton(df: DataFrame, text_col: str = "text", out: str = "skeleton") -> DataFrame:
    """df with the skeleton of a column; a column of that name is replaced. ASCII texts stand for themselves."""
    return df.withColumn(out, skeleton_column(F.col(text_col).cast("string")))


def _forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, looks, stored): hashes of the skeleton and of the text as stored, of rows that don't look blank."""
    rows = with_skeleton(df.select(F.col(id_col).alias("row"), F.col(text_col).alias("stored")), "stored", "looks").where(
        F.col("stored").isNotNull() & F.col("looks").rlike(r"(?U)\S")
    )
    return rows.select("row", F.unhex(F.md5("looks")).alias("looks"), F.unhex(F.md5("stored")).alias("stored"))


def look_alike_pairs(df: DataFrame, id_col: str = "row_id", text_col: str = "text", block: int = 5_000) -> DataFrame:
    """(row_a, row_b), row_a < row_b: rows whose texts look the same but are stored in different characters.

    Null texts and texts that look blank form no pair; equal texts form none with each other. An empty table gives none.

    Distinct stored forms of one look are paired first, and only then are their rows, so that no two rows meet that are not
    a result, however often one form is stored. Rows of a form with more than ``block`` of them are spread over as many
    tasks as they fill, on either side, so nothing is left out. Where all pairs are more than is wanted, as with a form
    that a third of all rows has, take ``look_alike_classes``.
    """
    rows = _forms(df, id_col, text_col)
    forms = rows.groupBy("looks", "stored").agg(F.count("*").alias("n"))
    shared = forms.groupBy("looks").agg(F.count("*").alias("forms")).where("forms > 1").select("looks")
    forms = forms.join(shared, "looks").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    part = F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part")
    members = rows.join(forms.select("stored", "parts"), "stored").select("stored", "row", part)
    other = forms.select("looks", F.col("stored").alias("stored_b"), F.col("parts").alias("parts_b"))
    pairs = forms.select("looks", F.col("stored").alias("stored_a"), F.col("parts").alias("parts_a")).join(other, "looks").where("stored_a < stored_b")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    spread = pairs.select("stored_a", "stored_b", "parts_b", every("parts_a").alias("part_a"))
    left = spread.join(members.select(F.col("stored").alias("stored_a"), F.col("part").alias("part_a"), F.col("row").alias("a")), ["stored_a", "part_a"])
    left = left.select("a", "stored_b", every("parts_b").alias("part_b"))
    both = left.join(members.select(F.col("stored").alias("stored_b"), F.col("part").alias("part_b"), F.col("row").alias("b")), ["stored_b", "part_b"])
    return both.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def look_alike_classes(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, forms, links): each row that doesn't look blank, the least id of the rows that look like it, in how
    many forms they are stored, and how many of them are stored in another form than the row's.

    One row for each row of df, however many pairs there are; counts go by form and then by look, so a hot form is
    combined before it is shuffled. Null texts and texts that look blank are left out.
    """
    rows = _forms(df, id_col, text_col)
    forms = rows.groupBy("looks", "stored").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    looks = forms.groupBy("looks").agg(F.sum("n").alias("whole"), F.count("*").alias("forms"), F.min("first").alias("class_id"))
    of_form = forms.join(looks, "looks").select("stored", "class_id", "forms", (F.col("whole") - F.col("n")).alias("links"))
    return rows.select(F.col("row").alias(id_col), "stored").join(of_form, "stored").drop("stored")
