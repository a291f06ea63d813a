"""Licence scans with DataFrame functions only.

Texts that hold none of a few keywords are passed over. In the others, words (lower-cased A-Z) are put in one line with
single blanks, and every rule whose own keyword occurs there is matched, in the order of ``license_rules``. Rules are
hand-written regexes over words with a label and a priority. A detection is an interval of words. One that lies inside
another is suppressed, of equal intervals the one of the lower priority (then the later label); of two that overlap in
part, from left to right, the one of the higher priority stays, the earlier if both are alike. The base phrases are
counted before suppression, and their labels stay.

Everything happens inside a row: no shuffle, no join. Nulls: a null text has no words and no detections. Rows that
repeat stay. A word or text of any length is scanned whole. An empty table gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_rules import signatures

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Fixed values of the base: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: A text without any of these (or "cc" before an ASCII character that isn't a letter) holds no detection.
GATE = ("licen", "domain", "gnu", "creative", "permission", "redistribut", "mozilla", "perl", "classpath", "beer", "evil")
GATE_CC = r"[cC][cC][\x00-\x40\x5B-\x60\x7B-\x7F]"
#: Steps of a walk along an array that are taken before their results are joined to those before.
BLOCK = 256


def rules() -> list[tuple[str, str, int, bool, str]]:
    """(label, keyword, priority, base, regex) of each rule."""
    out = [(label, phrase, 45, True, phrase) for phrase, label in BASE] + [(label, keyword, priority, False, regex) for label, priority, keyword, regex in signatures()]
    return [(*x[:4], f" {x[4]}(?= )") for x in out]


def _blanks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _walk(items: Column, first: Column, step, kind: str) -> Column:
    """Along an array with a state: step(state, item) gives the next state and a struct to put out, or null. (state, out) at the end.

    Arrays are made by blocks, so that a long walk doesn't copy all it has put out at each step.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(first.alias("s"), none.alias("out"))

    def one(a: Column, x: Column) -> Column:
        state, made = step(a["s"], x)
        return F.struct(state.alias("s"), F.when(made.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(made))).cast(f"array<{kind}>").alias("out"))

    def block(a: Column, i: Column) -> Column:
        own = F.aggregate(F.slice(items, i, F.lit(BLOCK)), F.struct(a["s"].alias("s"), none.alias("out")), one)
        return F.struct(own["s"].alias("s"), F.concat(a["out"], own["out"]).cast(f"array<{kind}>").alias("out"))

    return F.when(F.size(items) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), start, block)).otherwise(start)


DETECTION = "struct<first:int,size:int,label:string,priority:int,base:boolean>"


def _places(line: Column, rule: Column) -> Column:
    """All matches of a rule as structs (first, size, label, priority, base): words before a match are the blanks before it."""
    between, found = F.split(line, rule["regex"], -1), F.regexp_extract_all(line, rule["regex"], F.lit(0))
    steps = F.arrays_zip(F.transform(F.slice(between, F.lit(1), F.size(found)), _blanks).alias("gap"), F.transform(found, _blanks).alias("size"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        first = at + x["gap"]
        return first + x["size"], F.struct(first.alias("first"), x["size"].alias("size"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["base"].alias("base"))

    return _walk(steps, F.lit(0), step, DETECTION)["out"]


def _survivors(found: Column) -> Column:
    """Detections (first, until, rank: priority below 0, label) that lie in no other and win where they overlap, by their first word."""
    kind = "struct<first:int,until:int,rank:int,label:string>"
    # sorted by first word, the longest first: a later one can't contain an earlier one
    keyed = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-(d["first"] + d["size"])).alias("until"), (-d["priority"]).alias("rank"), d["label"].alias("label"))))
    keyed = F.transform(keyed, lambda d: F.struct(d["first"].alias("first"), (-d["until"]).alias("until"), d["rank"].alias("rank"), d["label"].alias("label")))

    def step(last: Column, d: Column) -> tuple[Column, Column]:
        apart = d["first"] >= last["until"]
        wins = apart | ((d["until"] > last["until"]) & (d["rank"] < last["rank"]))
        return F.when(last.isNull() | wins, d).otherwise(last), F.when(apart, last)

    out = _walk(keyed, F.lit(None).cast(kind), step, kind)
    return F.concat(out["out"], F.filter(F.array(out["s"]), lambda x: x.isNotNull()))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    outside = [F.substring(text, i, 1).rlike(f"^{BETWEEN}").cast("int") for i in (1, -1)]  # an empty part at either end
    n_words = F.when(text == "", 0).otherwise(F.size(F.split(text, f"{BETWEEN}+", -1)) - outside[0] - outside[1]).cast("long")
    low, gate = F.lower(text), text.rlike(GATE_CC)
    for k in GATE:
        gate |= F.contains(low, F.lit(k))
    line = F.when(gate, F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), " "), F.lit(" "))).otherwise("")
    families: dict[str, list[Column]] = {}
    for label, keywords, priority, base, regex in rules():
        rule = F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(base).alias("base"), F.lit(regex).alias("regex"))
        families.setdefault(keywords, []).append(rule)
    table = F.array(*[F.struct(F.array(*[F.lit(x) for x in k.split(",")]).alias("keywords"), F.array(*r).alias("rules")) for k, r in families.items()])
    # one-element arrays are exploded so that a line and its detections are made once
    out = docs.select(F.col(id_col), n_words.alias("n_words"), F.explode(F.array(line)).alias("line"))
    open_families = F.filter(table, lambda f: F.exists(f["keywords"], lambda k: F.contains(F.col("line"), k)))
    hits = F.flatten(F.transform(open_families, lambda f: f["rules"]))
    empty = F.array().cast(f"array<{DETECTION}>")
    found = F.when(F.col("line") == "", empty).otherwise(F.flatten(F.transform(hits, lambda r: _places(F.col("line"), r))))
    out = out.select(id_col, "n_words", F.explode(F.array(found)).alias("found"))
    out = out.select(id_col, "n_words", "found", F.filter("found", lambda d: d["base"]).alias("base"), F.explode(F.array(_survivors(F.col("found")))).alias("won"))
    out = out.withColumn("kept", F.transform("won", lambda d: F.struct(d["label"].alias("label"), (-d["rank"]).alias("priority"), d["first"].alias("first"), d["until"].alias("until"))))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base_labels = F.transform("base", lambda d: d["label"])
    starts = F.transform("base", lambda d: d["first"].cast("long"))
    return out.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base_labels).alias("base_labels"),
        names(F.concat(base_labels, F.transform("kept", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["priority"])) / 100.0, F.lit(0.0)).alias("score"), F.col("kept").alias("detections"),
    )
