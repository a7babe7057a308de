"""Text features as Spark columns; but for nfkc() none of them leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Chinese digits and units.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
NUMBER = "[0-9零〇一二兩三四五六七八九十百千]+"
FULL_WIDTH, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: Words that tell nothing of a text; a parameter of importance_tokens().
STOP_WORDS = ("的", "了", "在", "是", "有", "和", "就", "不", "都", "一", "上", "也", "很", "到", "要", "去", "會", "著", "沒有", "我們", "你們", "他們", "如果", "因為", "所以", "但是", "或者", "而且", "可以", "應該", "必須", "需要", "以及", "對於", "關於")
#: Runs of anything but letters, digits and underscores, and of Chinese characters.
BETWEEN = "[[^\\p{L}\\p{N}_]\\p{IsHan}]+"


def words(text: Column, least: int = 2, tokenizer: str = "bigram") -> Column:
    """Lower-cased words of at least `least` characters: runs of letters, digits and underscores of any script, then what the
    tokenizer makes of runs of Chinese characters: `bigram` overlapping pairs, `char` single characters, `run` whole runs.

    Chinese has no blanks between words; pairs stand in for a dictionary. Characters pass the length filter as they are.
    """
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _words(low, least, tokenizer))


def _words(low: Column, least: int, tokenizer: str) -> Column:
    runs = F.regexp_extract_all(low, F.lit("\\p{IsHan}+"), F.lit(0))
    pairs = lambda s: F.when(F.length(s) > 1, F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, 2))).otherwise(F.array(s))
    han = {"bigram": lambda: F.flatten(F.transform(runs, pairs)), "char": lambda: F.regexp_extract_all(low, F.lit("\\p{IsHan}"), F.lit(0)), "run": lambda: runs}[tokenizer]()
    long = F.filter(F.split(low, BETWEEN), lambda t: F.length(t) >= least)
    both = F.concat(long, han if tokenizer == "char" else F.filter(han, lambda t: F.length(t) >= min(least, 2)))
    return F.when(low.rlike("\\p{IsHan}"), both).otherwise(long)


def importance_tokens(text: Column, stop: tuple = STOP_WORDS) -> Column:
    """words() without stop words and plain numbers."""
    return F.filter(words(text), lambda t: ~t.isin(*stop) & ~t.rlike("^[0-9]+$"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode normal form KC; no built-in function gives it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc_like(text: Column) -> Column:
    """What NFKC does to the characters of labels: full-width digits, brackets, hyphens and blanks."""
    return F.translate(text, FULL_WIDTH + "（）－　", ASCII_DIGITS + "()- ")


def keywords(text: Column, k: int = 5) -> Column:
    """The k most frequent words, ties by their first place. Words are sorted once, each run of equal ones is a word."""
    def counted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i)["word"] != F.get(s, i - 1)["word"]))
        each = lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda p, j: F.struct((p - F.get(at, j + 1)).alias("less"), F.get(s, p)["at"].alias("at"), F.get(s, p)["word"].alias("word")))
        return F.transform(F.slice(F.array_sort(let(first, each)), 1, k), lambda x: x["word"])

    return let(F.array_sort(F.transform(words(text), lambda w, i: F.struct(w.alias("word"), i.alias("at")))), counted)


def chars(text: Column) -> Column:
    """Distinct lower-cased characters."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != ""))


def answer_tokens(text: Column) -> Column:
    """ASCII words, then single CJK characters."""
    low = F.lower(text)
    return F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), F.regexp_extract_all(low, F.lit("[\\x{4e00}-\\x{9fff}]"), F.lit(0)))


def ngrams(tokens: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def digits_normalised(text: Column) -> Column:
    return F.translate(text, FULL_WIDTH, ASCII_DIGITS)


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def cn_number(text: Column, append: bool = False) -> Column:
    """Chinese numeral to int, null without any numeral. append: a run of digits is a decimal number; else its last counts."""
    digits = CN_DIGITS | ({str(d): d for d in range(10)} if append else {})
    digit, unit = _lookup(digits), _lookup(CN_UNITS)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("num"), F.lit(False).alias("any"))

    def step(a: Column, c: Column) -> Column:
        d, u = digit[c], unit[c]
        num = F.when(d.isNotNull(), a["num"] * 10 + d if append else d).when(u.isNotNull(), F.lit(0)).otherwise(a["num"])
        total = F.when(u.isNotNull(), a["total"] + F.when(a["num"] == 0, 1).otherwise(a["num"]) * u).otherwise(a["total"])
        return F.struct(total.alias("total"), num.alias("num"), (a["any"] | d.isNotNull() | u.isNotNull()).alias("any"))

    folded = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return let(folded, lambda f: F.when(f["any"], f["total"] + f["num"]))


def cn_numeral(n: Column) -> Column:
    """1 to 99 as a Chinese numeral."""
    names = F.array(*[F.lit(x) for x in "一二三四五六七八九"])
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    unit = F.when(ones > 0, F.element_at(names, F.greatest(ones, F.lit(1)))).otherwise("")
    return F.when(n < 10, unit).when(tens == 1, F.concat(F.lit("十"), unit)).otherwise(F.concat(F.element_at(names, F.greatest(tens, F.lit(1))), F.lit("十"), unit))


def label_number(text: Column) -> Column:
    """A number of a label: digits, full-width or not, or a Chinese numeral (of a digit run the last counts); null if empty."""
    return let(digits_normalised(text), lambda plain: F.when(plain == "", None).when(plain.rlike("^[0-9]+$"), plain.cast("int")).otherwise(cn_number(plain)))


def article(label: Column) -> tuple[Column, Column]:
    """Article number and suffix of 第N條之M, 第N-M條 or 第N條, in this order."""
    label = digits_normalised(label)
    of = lambda p, i: label_number(F.regexp_extract(label, p, i))
    after, dash, plain = f"第\\s*({NUMBER})\\s*條之\\s*({NUMBER})", f"第\\s*({NUMBER})\\s*[-－]\\s*({NUMBER})\\s*條", f"第\\s*({NUMBER})\\s*條"
    return F.coalesce(of(after, 1), of(dash, 1), of(plain, 1)), F.coalesce(of(after, 2), of(dash, 2))


#: What tells of a reference to the text itself, its law, and other laws.
REFERENCES = (("internal_reference", "前項|前條|準用之|依.*規定|比照.*辦理|適用.*規定"), ("self_reference", "本法|本條例|本規則|本辦法"), ("external_reference", "其他法律|相關法規|其他法規|其他條例"))


def cross_references(text: Column) -> Column:
    """Distinct articles, items and clauses that a text names, and what kinds of reference it makes, sorted."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(f"第[一二三四五六七八九十百千0-9]+{u}"), F.lit(0)) for u in ("條", "項", "款")])
    tags = F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in REFERENCES]), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(found, tags)))


def line_class(line: Column) -> Column:
    """Which part of a statute a line opens: chapter, section, article, paragraph, subparagraph, item, or content."""
    return (
        F.when(line.rlike(f"^第{NUMBER}章"), "chapter").when(line.rlike(f"^第{NUMBER}節"), "section").when(line.rlike(f"^第{NUMBER}條"), "article")
        .when(line.rlike("^[0-9]+[.．\\s]"), "paragraph").when(line.rlike("^[一二三四五六七八九十]+、"), "subparagraph")
        .when(line.rlike("^[（(][一二三四五六七八九十]+[)）]"), "item").otherwise("content")
    )
