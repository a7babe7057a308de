"""What labels and contents of statutes tell, as columns: numbers, names, levels, positions, semantic flags. All of it stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .text import CN_DIGITS, CN_UNITS, let

NUM = "[0-9一二兩三四五六七八九十百千〇零]+"
BLANK = "[ \\t\\n\\r\\f\\u3000]+"
#: The unit that ends a label of each level.
LEVEL_UNITS = {"chapter": "章", "section": "節", "article": "條", "paragraph": "項", "subparagraph": "款", "item": "目"}


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text holds."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(patterns))


def held(text: Column, words: tuple[str, ...]) -> Column:
    """The words that the text holds, in their order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def first_group(text: Column, *patterns: str) -> Column:
    """The first group of the first pattern that matches, or null."""
    found = [F.regexp_extract(text, p, 1) for p in patterns]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def number(text: Column) -> Column:
    """A label's number: digits, Chinese numerals (digit runs are decimal numbers), or parts of both joined by a hyphen, which add
    up. Other characters are passed over; null if there is no digit or numeral."""
    digits = {k: v for k, v in CN_DIGITS.items()} | {"兩": 2} | {str(d): d for d in range(10)}
    look = lambda t: F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
    digit, unit = look(digits), look(CN_UNITS)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("num"), F.lit(False).alias("any"))

    def step(a: Column, c: Column) -> Column:
        d, u = digit[c], unit[c]
        num = F.when(d.isNotNull(), a["num"] * 10 + d).when(u.isNotNull() | (c == "-"), F.lit(0).cast("long")).otherwise(a["num"])
        total = a["total"] + F.when(u.isNotNull(), F.greatest(a["num"], F.lit(1)) * u).when(c == "-", a["num"]).otherwise(0)
        return F.struct(total.cast("long").alias("total"), num.cast("long").alias("num"), (a["any"] | d.isNotNull() | u.isNotNull()).alias("any"))

    folded = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)
    return let(folded, lambda f: F.when(f["any"], f["total"] + f["num"]))


def level_info(label: Column, level: str) -> Column:
    """struct<text, number, suffix, canonical, key> of a label of one of the six levels; null without a label.

    An article's canonical form is N or N-M. Paragraphs and below may be plain numerals in brackets or before a mark. The key
    is the canonical form, the number, or the label without white space.
    """
    def parts(text: Column, plain: Column, main: Column) -> Column:
        n = number(main)
        if level in ("paragraph", "subparagraph", "item"):
            n = F.coalesce(n, F.when(main.isNull(), number(F.regexp_replace(plain, "[（()）)．、.]", ""))))
        suffix = number(first_group(plain, f"第{NUM}條之({NUM})")) if level == "article" else F.lit(None).cast("long")
        return let(F.struct(n.cast("string").alias("n"), suffix.cast("string").alias("suffix")), lambda x: info(text, plain, x["n"], x["suffix"]))

    def info(text: Column, plain: Column, n: Column, suffix: Column) -> Column:
        canonical = F.concat_ws("-", n, suffix)
        known = n.isNotNull()
        return F.struct(text.alias("text"), n.alias("number"), F.when(known, suffix).alias("suffix"), F.when(known & F.lit(level == "article"), canonical).alias("canonical"), F.coalesce(F.when(known, canonical), plain).alias("key"))

    made = let(F.regexp_replace(F.trim(label), BLANK, ""), lambda plain: let(first_group(plain, f"第({NUM}){LEVEL_UNITS[level]}"), lambda main: parts(F.trim(label), plain, main)))
    return F.when(F.trim(label) != "", made)


def position(full: Column, target: Column) -> Column:
    """struct<start, end, found, confidence>: where target stands in full, white space collapsed; its first 15 characters will do
    with confidence .7 if it is longer than 10."""
    def place(whole: Column, part: Column) -> Column:
        exact, near = F.instr(whole, part) - 1, F.instr(whole, F.substring(part, 1, 15)) - 1
        size = F.length(part)
        hit = (size > 0) & (exact >= 0)
        at = F.when(hit, exact).when((size > 10) & (near >= 0), near)
        sure = F.when(hit, 1.0).when(at.isNotNull(), 0.7).otherwise(0.0)
        return F.struct(F.coalesce(at, F.lit(0)).alias("start"), F.coalesce(at + size, F.lit(0)).alias("end"), at.isNotNull().alias("found"), sure.alias("confidence"))

    return let(F.struct(F.regexp_replace(full, BLANK, " ").alias("whole"), F.regexp_replace(F.trim(target), BLANK, " ").alias("part")), lambda x: place(x["whole"], x["part"]))


def _first_law(content: Column, ends: str) -> Column:
    """The first stretch without `ends` that holds 法 behind another character, up to its last 法; null if there is none. Splitting
    first keeps a pattern from running over a whole text from each of its characters."""
    found = F.filter(F.split(content, f"[{ends}]"), lambda s: F.instr(F.substring(s, 2, F.length(s)), "法") > 0)
    return F.regexp_extract(F.get(found, F.lit(0)), "(?s)^(.+法)", 1)


def law_name(content: Column) -> Column:
    """The name in 【】, else the first run before 法 without words of place; empty if there is none."""
    return F.coalesce(F.trim(F.coalesce(first_group(content, "【([^】]+)】"), _first_law(content, "第章節條項"))), F.lit(""))


def law_name_of_id(id_: Column) -> Column:
    """The law's name in an id like 法規名稱：X_0_... or X_0_... where X is a statute; empty if there is none."""
    first = F.trim(F.element_at(F.split(id_, "_"), 1))
    return F.coalesce(first_group(id_, "法規名稱：([^_]+)"), F.when(any_of(first, ("法", "條例")), first), F.lit(""))


ARTICLE_NUMBERS = ("第([0-9]+條)", "第([一二三四五六七八九十百千]+)條", "第([0-9]+-[0-9]+條)", "第([0-9]+[之-][0-9]+條)")


def article_number(content: Column) -> Column:
    """第 and the number of the first short line (under 50 characters) that has an article's number, else of the whole text."""
    lines = F.transform(F.split(content, "\n"), lambda s: F.regexp_replace(s, "^[ \\t\\r\\u3000]+|[ \\t\\r\\u3000]+$", ""))
    short = F.filter(lines, lambda s: (F.length(s) < 50) & s.rlike("|".join(ARTICLE_NUMBERS)))
    found = first_group(F.coalesce(F.get(short, F.lit(0)), content), *ARTICLE_NUMBERS)
    return F.coalesce(F.concat(F.lit("第"), found), F.lit(""))


def _ordinal(label: Column, unit: str) -> Column:
    return F.when(label.rlike(f"^[第{unit}]"), label).otherwise(F.concat(F.lit("第"), label, F.lit(unit)))


def description(law: Column, chapter: Column, section: Column, article: Column, content: Column, items: Column) -> Column:
    """Law, chapter, section, article and items in words. The content's own article number goes before the label's; unclassified
    chapters and sections are left out. items: array of item numbers."""
    named = lambda c: F.when(c != "", c)
    first, last = F.get(items, F.lit(0)), F.get(items, F.size(items) - 1)
    span = F.when(F.size(items) == 1, F.concat(F.lit("第"), first, F.lit("項"))).when(F.size(items) > 1, F.concat(F.lit("第"), first, F.lit("-"), last, F.lit("項")))
    return F.concat_ws(
        " ",
        F.coalesce(named(F.replace(law, F.lit("法規名稱："), F.lit(""))), named(law_name(content))),
        F.when(~chapter.isin("", "未分類章", "未分類節"), _ordinal(chapter, "章")),
        F.when(~section.isin("", "未分類節"), _ordinal(section, "節")),
        F.coalesce(named(article_number(content)), F.when(article != "", _ordinal(article, "條"))),
        span,
    )


def semantics(content: Column) -> Column:
    """struct of flags (definition, procedural, enumeration, normative, refers) and concept_density, keywords held per word."""
    words = F.size(F.filter(F.split(content, "[ \\t\\n\\r\\f]+"), lambda w: w != ""))
    density = count_of(content, V.LEGAL_KEYWORDS) / F.greatest(words, F.lit(1))
    return F.struct(
        matches(content, V.DEFINITION).alias("definition"), matches(content, V.PROCEDURE).alias("procedural"), matches(content, V.ENUMERATION).alias("enumeration"),
        matches(content, V.NORM).alias("normative"), content.rlike("第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條").alias("refers"), density.alias("concept_density"),
    )


def granularity(part: Column, content: Column) -> Column:
    """Granularity level of a kind of part; a definition article of over 200 characters counts as a unit's component."""
    level = F.when((part == "article") & (F.length(content) > 200) & semantics(content)["definition"], "basic_unit_component")
    for kind, name in {"law": "document", "chapter": "document_component", "section": "basic_unit_hierarchy", "article": "basic_unit", "paragraph": "basic_unit_component", "subparagraph": "enumeration", "item": "enumeration"}.items():
        level = level.when(part == kind, name)
    return level.otherwise("basic_unit")


def hierarchy(content: Column) -> Column:
    """article, section, chapter or general, by what the text holds; the first that applies."""
    number_ = "第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*"
    return (
        F.when(content.rlike(f"{number_}條"), "article").when(content.rlike(f"{number_}[節章]"), "section").when(content.rlike("總則|附則"), "chapter")
        .when(content.rlike("條文|規定|權利|義務|禁止|處罰"), "article").otherwise("general")
    )


def article_keys(content: Column) -> Column:
    """array<string>: the articles that a text names, N for 第N條 alone and N-M for 第N條之M or 第N條-M, white space apart.

    A suffix names all its leading digits, too: 之12 answers to 1 and to 12.
    """
    plain = F.regexp_replace(content, "[ \\u3000]+", "")
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit("第[0-9]+條(?:[之-][0-9]*|[0-9]+)?"), F.lit(0)))

    def keys(m: Column) -> Column:
        n, suffix = F.regexp_extract(m, "第([0-9]+)條", 1), F.regexp_extract(m, "條[之-]([0-9]*)", 1)
        return F.when(F.endswith(m, F.lit("條")), F.array(n)).when(suffix != "", F.transform(F.sequence(F.lit(1), F.length(suffix)), lambda k: F.concat(n, F.lit("-"), F.substring(suffix, F.lit(1), k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(found, keys)))


def law_match(content: Column, law: Column) -> Column:
    """Whether a text can be of a law: it names it or a variant, or any article at all. No law asked for: yes."""
    low = F.lower(content)
    named = F.contains(low, law)
    for name, words in V.LAW_VARIANTS.items():
        named = F.when(law == name, any_of(low, words)).otherwise(named)
    return F.coalesce(law, F.lit("")).eqNullSafe("") | named | low.rlike("第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條")


# --- levels of chunks by metadata and content ---------------------------------------------------------------------------------
def is_article(content: Column, level: Column) -> Column:
    return F.coalesce(level.isin("basic_unit", "article"), F.lit(False)) | content.rlike("第[一二三四五六七八九十0-9]+條|條文|規定")


def is_chapter_or_section(content: Column, level: Column) -> Column:
    return F.coalesce(level.isin("document_component", "basic_unit_hierarchy", "chapter", "section"), F.lit(False)) | content.rlike("第[一二三四五六七八九十0-9]+[章節]|[章節][ \\t]*[：:]|總則|分則|附則")


def article_id(content: Column, category: Column, number_: Column) -> Column:
    """LAW_第N條 by metadata, else by the first article number and the first run before 法 in the text; null without both."""
    n = F.regexp_extract(content, "第([0-9]+)條", 1)
    law = F.coalesce(_first_law(content, "。，；："), F.lit(""))
    known = F.when((category != "") & number_.isNotNull(), F.concat(category, F.lit("_第"), number_.cast("string"), F.lit("條")))
    return F.coalesce(known, F.when((n != "") & (law != ""), F.concat(law, F.lit("_第"), n, F.lit("條"))))


# --- cleaning -----------------------------------------------------------------------------------------------------------------
ENDS = "。！？.!?"


def _left_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within `most` UTF-8 bytes."""
    fits = lambda n: F.octet_length(F.substring(text, F.lit(1), n)) <= most
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(text, F.lit(1), F.aggregate(steps, F.lit(0), lambda n, i: F.when(fits(n + i), n + i).otherwise(n))))


def _last(text: Column, marks: str) -> Column:
    """1-based position of the last of several single characters, 0 if there is none."""
    back = F.reverse(text)
    found = [F.instr(back, m) for m in marks]
    near = F.least(*[F.when(f > 0, f) for f in found]) if len(found) > 1 else F.when(found[0] > 0, found[0])
    return F.coalesce(F.length(text) - near + 1, F.lit(0))


def cleaned(text: Column, most: int = 30_000) -> Column:
    """Text without control characters and brackets, with at most one blank line in a row, and cut to `most` bytes: behind the
    last blank line, or the last sentence, of its last fifth if there is one."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    out = F.regexp_replace(out, "[【】〖〗『』［］〔〕｛｝〈〉《》「」]", "")
    out = F.regexp_replace(out, "\\n[ \\t\\n]*\\n[ \\t\\n]*\\n+", "\n\n")
    out = F.regexp_replace(F.regexp_replace(out, " +", " "), "(?m)^[ \\t]+|[ \\t]+$", "")

    def tail_cut(kept: Column) -> Column:
        base = F.floor(F.length(kept) * 0.8).cast("int")

        def cut(tail: Column) -> Column:
            paragraph = F.length(tail) - F.instr(F.reverse(tail), "\n\n")  # 1-based place of the pair's first character
            ends = F.when(F.instr(tail, "\n\n") > 0, paragraph - 1).when(_last(tail, ENDS) > 0, _last(tail, ENDS))
            return F.coalesce(F.substring(kept, F.lit(1), base + ends), kept)

        return let(F.substring(kept, base + 1, F.length(kept)), cut)

    def whole(t: Column) -> Column:
        return F.when(F.octet_length(t) <= most, t).otherwise(let(_left_bytes(t, most), tail_cut))

    return F.regexp_replace(let(out, whole), "^[ \\t\\n\\r]+|[ \\t\\n\\r]+$", "")
