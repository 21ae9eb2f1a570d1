"""Column functions over text; white space, digits and letters are Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def normalize_pattern(x: Column) -> Column:
    """Digits become {n}, runs of white space one blank."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"\p{Nd}+", "{n}"), f"{WS}+", " "))


def normalize_heading(x: Column) -> Column:
    return F.regexp_replace(x, f"{WS}+", "")


def count_class(x: Column, chars: str) -> Column:
    return (F.length(x) - F.length(F.regexp_replace(x, chars, ""))).cast("long")


CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"


def html_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# Keywords of the content categories, in the order in which they are tried.
CATEGORY_RULES = (
    ("PAYMENT", "價金|給付|付款|計價|費用"), ("ACCEPTANCE", "驗收|查驗"), ("TRAINING", "訓練|教育"), ("TRANSITION", "退場|移轉"),
    ("SCOPE", "目標|範圍|概述|背景"), ("MAINTENANCE", "維運|維護|保養|支援"), ("DELIVERABLE", "交付|產出|文件|報告"), ("MILESTONE", "時程|期限|里程碑"),
    ("QUALITY", "品質|檢核"), ("MANAGEMENT", "管理|組織|人力"), ("CONSTRAINT", "限制|約束|條件"), ("SECURITY_ACTIVITY", "安全|資安"), ("SCOPE", "功能|系統|新增|異動"),
)


def classify_title(title: Column) -> Column:
    """Category of the first rule that matches the title, else UNCLASSIFIED."""
    flat, out = normalize_heading(title), F.lit("UNCLASSIFIED")
    for category, words in reversed(CATEGORY_RULES):
        out = F.when(flat.rlike(words), category).otherwise(out)
    return out


def toc_like(x: Column) -> Column:
    return x.contains("....") | x.contains("…")


# Numerals that head a contents line, what may fill it up, and the patterns of contents lines and captions.
_NUMERALS = "壹貳參肆伍陸柒捌玖拾一二三四五六七八九十"
_SUB_NUMERALS = r"一二三四五六七八九十\p{Nd}"
_TO_PAGE = rf"{WS}*(.+?){WS}*[.…·]+{WS}*(\p{{Nd}}+){WS}*$"
_TOC_MAIN = rf"^([{_NUMERALS}]+)[、.．]{_TO_PAGE}"
_TOC_SUB = rf"^[（(]([{_SUB_NUMERALS}]+)[）)]{_TO_PAGE}"
_CAPTION_RAW = rf"^表{WS}*(\p{{Nd}}+){WS}+(.+)"
_CAPTION_TIGHT = r"^表(\p{Nd}+)(.+)"
_CAPTION_HEAD = r"^表\p{Nd}+"
_BOXES = "[│├┤┬┴┼─]"


def digits_value(x: Column) -> Column:
    """The number that digits stand for, full-width ones included."""
    return F.translate(x, "０１２３４５６７８９", "0123456789").cast("long")


def toc_entry(line: Column) -> Column:
    """(title, page, level) of a contents line, null for others: a single numeral is level 1, others and those in brackets level 2."""
    line = strip(line)

    def entry(pattern: str, title: Column, level: Column) -> Column:
        return F.when(line.rlike(pattern), F.struct(strip(title).alias("title"), digits_value(F.regexp_extract(line, pattern, 3)).alias("page"), level.cast("long").alias("level")))

    numeral = F.regexp_extract(line, _TOC_MAIN, 1)
    first = entry(_TOC_MAIN, F.concat(numeral, F.lit("、"), strip(F.regexp_extract(line, _TOC_MAIN, 2))), F.when(F.length(numeral) == 1, 1).otherwise(2))
    return F.coalesce(first, entry(_TOC_SUB, F.regexp_extract(line, _TOC_SUB, 2), F.lit(2)))


def toc_heading(x: Column) -> Column:
    """True for a block that begins with the word for contents."""
    return normalize_heading(x).rlike("^目[次錄]")


def caption(line: Column) -> Column:
    """A table caption with its number's leading zeros gone, empty for other lines."""
    line = strip(line)

    def made(x: Column, pattern: str) -> Column:
        return F.when(x.rlike(pattern), F.concat(F.lit("表"), digits_value(F.regexp_extract(x, pattern, 1)).cast("string"), F.lit(" "), F.regexp_extract(x, pattern, 2)))

    return F.coalesce(made(line, _CAPTION_RAW), made(normalize_heading(line), _CAPTION_TIGHT), F.lit(""))


def caption_like(x: Column) -> Column:
    """True for a block that begins like a table caption, white space aside."""
    return normalize_heading(x).rlike(_CAPTION_HEAD)


def boxed(x: Column) -> Column:
    """True for text with box-drawing characters."""
    return x.rlike(_BOXES)


def _common_han() -> str:
    """Ideographs that Big5 can write, and the blocks of CJK and full-width punctuation."""
    han = (chr(c) for c in range(0x4E00, 0xA000) if chr(c).encode("big5", "ignore"))
    return "".join([*han, *map(chr, range(0x3000, 0x3040)), *map(chr, range(0xFF01, 0xFF61))])


def count_common_han(x: Column) -> Column:
    """Common characters other than white space; a translation, as a pattern of so many ranges is slow."""
    flat = normalize_heading(x)
    return (F.length(flat) - F.length(F.translate(flat, _common_han(), ""))).cast("long")


def text_stats(x: Column) -> Column:
    """Counts and shares of character classes without white space.

    Ideographs count by themselves.  Common characters, letters and digits, and
    symbols exclude each other in this order.  A null or empty text has zeros.
    """
    flat = normalize_heading(F.coalesce(x, F.lit("")))
    rest, total = F.translate(flat, _common_han(), ""), F.length(flat)

    def count(of: Column, chars: str) -> Column:
        return F.regexp_count(of, F.lit(chars)).cast("long")

    counts = {"cjk": count(flat, CJK), "common_han": (total - F.length(rest)).cast("long"), "alnum": count(rest, r"[\p{L}\p{N}]"), "symbol": count(rest, r"[\p{P}\p{S}\p{Cc}]")}
    shares = [F.when(total == 0, 0.0).otherwise(n / total).alias(f"{k}_ratio") for k, n in counts.items()]
    return F.struct(total.cast("long").alias("char_count"), *[n.alias(f"{k}_count") for k, n in counts.items()], *shares)
