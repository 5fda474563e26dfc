"""Texts that look alike but are stored in different characters, brought to one form.

Per character: invisible characters are dropped, blanks of all kinds become a space, hyphens one hyphen, width and presentation
forms (ligatures, radicals, compatibility ideographs) their plain characters; superscripts, subscripts, circled and squared
signs look different and stay. Combining marks are composed (NFC). Per token: each letter has the set of scripts in which some
letter looks like it; the sets are intersected over the token. A token of several scripts is spelled in the script of the
intersection, a token of another script that could wholly be Latin is spelled in Latin unless the same text proves its script
by a letter that has no Latin look-alike.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = dict(zip("АВЕКМНОРСТХІЈЅУаеорсухіјѕһԁԛԝ", "ABEKMHOPCTXIJSYaeopcyxijshdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj"))
LOOKALIKES = {"Cyrillic": CYRILLIC, "Greek": GREEK}
# CJK radicals supplement, and the ideographs with the same shape.
RADICALS = "⺁厂⺅亻⺆冂⺈刀⺉刂⺌小⺍小⺎兀⺏尣⺐尢⺑尣⺒巳⺓幺⺔彑⺕彐⺖忄⺘扌⺙攵⺛旡⺜日⺝月⺞歺⺟母⺠民⺡氵⺢氺⺣灬⺤爫⺥爫⺦丬⺧牛⺨犭⺩王⺪疋⺫罒⺬示⺭礻⺮竹⺯糹⺰纟⺱罓⺲罒⺶羊⺷羊⺸羋⺹耂⺺肀⺻聿⺼肉⺽臼⺾艹⺿艹⻀艹⻁虎⻂衤⻃覀⻄西⻅见⻆角⻈讠⻉贝⻊足⻋车⻌辶⻍辶⻎辶⻏邑⻐钅⻑長⻒镸⻓长⻔门⻕阜⻖阝⻗雨⻘青⻙韦⻚页⻛风⻜飞⻝食⻞飠⻟飠⻠饣⻡首⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻫斉⻬齐⻭歯⻮齿⻯竜⻰龙⻱龜⻲亀⻳龟"
HYPHENS = "‐‑"
KEEP = {"<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>"}
TOKEN = re.compile("(?:[A-Za-z]|[À-ʯ]|[Ͱ-ϿЀ-ԯ])+")
FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")


class _Forms(dict):
    """Translation table that is filled as characters are met."""

    def __missing__(self, point: int) -> int | str:
        char = chr(point)
        category = unicodedata.category(char)
        kind = unicodedata.decomposition(char).partition(" ")[0]
        if category == "Cf" or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF:
            out: int | str = ""
        elif category == "Zs":
            out = " "
        elif char in HYPHENS:
            out = "-"
        elif point < 0x80 or kind in KEEP or category.startswith("M"):
            out = point
        else:
            out = unicodedata.normalize("NFKC", char)
            out = " " if out.isspace() and kind else out
        self[point] = out
        return out


@lru_cache(1)
def forms() -> dict[int, int | str]:
    table = _Forms()
    table.update({ord(a): b for a, b in zip(RADICALS[::2], RADICALS[1::2])})
    return table


def scripts(char: str) -> set[str]:
    """The scripts with a letter that looks like ``char``."""
    own = "Greek" if "Ͱ" <= char <= "Ͽ" else "Cyrillic" if "Ѐ" <= char <= "ԯ" else "Latin"
    latin = char if own == "Latin" else LOOKALIKES[own].get(char)
    return {own} if latin is None else {own, "Latin"} | {s for s, letters in LOOKALIKES.items() if latin in letters.values()}


def own_script(char: str) -> str:
    return "Greek" if "Ͱ" <= char <= "Ͽ" else "Cyrillic" if "Ѐ" <= char <= "ԯ" else "Latin"


def spell(token: str, script: str) -> str:
    """``token`` with each letter in the look-alike of ``script``, where it has one."""
    out = []
    for char in token:
        own = own_script(char)
        latin = char if own == "Latin" else LOOKALIKES[own].get(char)
        if own == script or latin is None:
            out.append(char)
        elif script == "Latin":
            out.append(latin)
        else:
            out.append(next((c for c, x in LOOKALIKES[script].items() if x == latin), char))
    return "".join(out)


def one_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null."""
    if text is None:
        return None
    text = unicodedata.normalize("NFC", text.translate(forms()))
    if not FOREIGN.search(text):
        return text
    proved = {own_script(c) for c in set(FOREIGN.findall(text)) if "Latin" not in scripts(c)}

    def fix(match: re.Match) -> str:
        token = match[0]
        used = {own_script(c) for c in token}
        if used == {"Latin"}:
            return token
        shared = set.intersection(*[scripts(c) for c in token])
        if len(used) == 1:  # of one other script: a whole-script look-alike, or real text of that script
            return spell(token, "Latin") if "Latin" in shared and not used & proved else token
        if shared:
            return spell(token, "Latin" if "Latin" in shared else min(shared))
        return spell(token, max(sorted(used), key=lambda s: sum(own_script(c) == s for c in token)))

    return TOKEN.sub(fix, text)


def _forms_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([one_form(t) for t in batch.column(1).to_pylist()], pa.string())], ["key", "text", "form"])


def consistent_forms(records: DataFrame) -> DataFrame:
    """(key, text, form) of each record's text; other columns are ignored, null and empty texts keep their value."""
    kind = records.schema["key"].dataType.simpleString()
    return records.select("key", "text").mapInArrow(_forms_of_batches, f"key {kind}, text string, form string")


def _hashed_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def md5(text: str) -> str:
        return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()

    for batch in batches:
        texts = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([md5(t) for t in texts], pa.string()), pa.array([md5(one_form(t)) for t in texts], pa.string())], ["record_table", "key", "stored", "form"])


def alike_pairs(records: DataFrame) -> DataFrame:
    """(record_table, key_a, key_b), key_a < key_b, of records of one table that differ in stored characters but have one form.

    ``records`` has record_table, key (as strings), text. Only hashes of the stored text and of its form leave the pass over the
    texts. Exact copies of a stored text form a class. Classes of one form are paired by their smallest keys, every other member of
    a class with the class of the smallest key that is stored otherwise, so copies cost one row each. Null and empty texts, null
    keys and null tables match nothing; repeated rows count once.
    """
    told = records.filter("key is not null and record_table is not null and text <> ''").select(F.col("record_table").cast("string"), F.col("key").cast("string"), "text")
    # No column can be null, and every use takes ``m``, so all have one plan and the texts are read once.
    told = told.mapInArrow(_hashed_forms, "record_table string not null, key string not null, stored string not null, form string not null")
    members = told.groupBy("record_table", "form", "stored", "key").agg(F.count("*").alias("m"))
    classes = members.groupBy("record_table", "form", "stored").agg(F.min(F.struct("key", "m")).alias("c"))
    several = classes.groupBy("record_table", "form").agg(F.count("c").alias("n"), F.min(F.struct(F.col("c.key").alias("key"), "stored")).alias("one")).filter("n > 1")
    kept = classes.join(several.select("record_table", "form", "one"), ["record_table", "form"]).select("record_table", "form", "stored", F.col("c.key").alias("first_key"), "one")
    pairs = kept.alias("a").join(kept.alias("b"), ["record_table", "form"]).filter("a.first_key < b.first_key").select("record_table", F.col("a.first_key").alias("key_a"), F.col("b.first_key").alias("key_b"))
    second = kept.filter("stored <> one.stored").groupBy("record_table", "form").agg(F.min("first_key").alias("second"))
    others = members.filter("m > 0").join(kept.join(second, ["record_table", "form"]), ["record_table", "form", "stored"]).filter("key > first_key")
    partner = F.when(F.col("stored") == F.col("one.stored"), F.col("second")).otherwise(F.col("one.key"))
    rest = others.select("record_table", F.least("key", partner).alias("key_a"), F.greatest("key", partner).alias("key_b"))
    return pairs.unionByName(rest).distinct()
