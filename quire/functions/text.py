"""Column functions on text, with Python's notion of white space and letters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip removes, as a Java class.
BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}]"


def py_strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(py_strip(F.coalesce(c, F.lit("")))) == 0


def flat(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def compare_key(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, f"{BLANK}+", ""))


def share_of(c: Column, java_class: str) -> Column:
    """Share of the characters that are in a class; 0 for empty text."""
    n = F.length(c)
    return F.when(n > 0, (n - F.length(F.regexp_replace(c, java_class, ""))) / n).otherwise(F.lit(0.0))


def title_case(c: Column) -> Column:
    """First letter upper, the rest lower with a cased letter among them."""
    rest = F.substring(c, 2, 1 << 30)
    return c.rlike(r"^\p{Lu}") & (F.lower(rest) == rest) & (F.upper(rest) != rest)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{L}[\p{L}'\-]*"), 0)


def han_numeral(n: Column) -> Column:
    """1 to 9999 in Chinese numerals, as used in headings."""
    digit = lambda d: F.substring(F.lit("零一二三四五六七八九"), d.cast("int") + 1, F.lit(1))
    th, hu, te, on = (F.floor(n / k) % 10 for k in (1000, 100, 10, 1))
    out = F.when(th > 0, F.concat(digit(th), F.lit("千"))).otherwise("")
    out = F.concat(out, F.when(hu > 0, F.concat(digit(hu), F.lit("百"))).when((th > 0) & (n % 100 > 0), "零").otherwise(""))
    tens = F.when((te == 1) & (n < 20), "十").when(te > 0, F.concat(digit(te), F.lit("十"))).when((hu > 0) & (on > 0), "零").otherwise("")
    return F.concat(out, tens, F.when(on > 0, digit(on)).otherwise(""))


def number_heading(c: Column) -> Column:
    """The Arabic number of a heading marker at the start, 1 to 9999, in Chinese; else the text as it is."""
    mark = rf"^({BLANK}*第)([0-9０-９]+)([章节部卷回])"
    n = F.translate(F.regexp_extract(c, mark, 2), "０１２３４５６７８９", "0123456789").try_cast("bigint")
    return F.when(n.between(1, 9999), F.concat(F.regexp_extract(c, mark, 1), han_numeral(n), F.regexp_extract(c, mark, 3), F.regexp_replace(c, mark, ""))).otherwise(c)


# What counts as a Chinese neighbour of half-width punctuation, and its full-width forms.
_CHINESE = "一-鿿぀-ヿ＀-￯“”‘’（）《》【】、，。！？：；…—"
_FULL_WIDTH = {",": "，", ".": "。", "!": "！", "?": "？", ":": "：", ";": "；"}
#: A noncharacter that marks what one pass has found.
_FOUND = "\ufdd0"


def _alternating(c: Column, mark: str, opening: str, closing: str) -> Column:
    """Every other ``mark`` of the text becomes ``opening``, the rest ``closing``."""
    parts = F.split(c, mark, -1)
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit(opening), x)).otherwise(F.concat(F.lit(closing), x))), "")


def normalize_zh(c: Column) -> Column:
    """Punctuation of a Chinese text: curly quotes, six-dot ellipses, double dashes, full width next to
    Chinese characters, no blanks after closing punctuation. Null stays null."""
    c = F.translate(c, "「」『』", "“”‘’")
    c = _alternating(c, '"', "“", "”")
    c = F.regexp_replace(c, r"(?<=[A-Za-z])'(?=[A-Za-z])", "’")
    c = _alternating(c, "'", "‘", "’")
    c = F.regexp_replace(F.regexp_replace(c, r"。{3,}|・{2,}|\.{3,}", "…"), "…+", "……")
    c = F.regexp_replace(F.regexp_replace(c, "-{2,}", "—"), "—+", "——")
    half = "[" + "".join(_FULL_WIDTH) + "]"
    c = F.regexp_replace(c, f"(?<=[{_CHINESE}])({half})|({half})(?=[{_CHINESE}])", f"{_FOUND}$1$2")
    for narrow, wide in _FULL_WIDTH.items():
        c = F.replace(c, F.lit(_FOUND + narrow), F.lit(wide))
    return F.regexp_replace(c, f"([，。！？：；、”’》】]){BLANK}+", "$1")


def all_caps(c: Column) -> Column:
    """Two characters or more without a small letter, and no Roman numeral."""
    return (F.length(c) >= 2) & (F.upper(c) == c) & (F.lower(c) != c) & ~roman(c)


def roman(c: Column) -> Column:
    return c.rlike(r"^[IVXLCDM]+\z")


HAN = "\u4e00-\u9fff"


def has_han(c: Column) -> Column:
    return c.rlike(f"[{HAN}]")


def only_han(c: Column) -> Column:
    return c.rlike(rf"^[{HAN}]+\z")


def latin_name(c: Column) -> Column:
    """ASCII letters with blanks, dots and hyphens after the first letter."""
    return c.rlike(r"^[A-Za-z][A-Za-z .\-]*\z")


def han_ratio(c: Column) -> Column:
    """Share of Han characters; 0 for empty text."""
    return share_of(c, f"[{HAN}]")


def slug(c: Column, default: str = "book") -> Column:
    """Runs of characters that are no word characters, kana, Han or hyphens become one underscore."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w一-鿿぀-ヿ-]+", "_"), "^_+|_+$", "")
    return F.when(F.length(F.coalesce(s, F.lit(""))) == 0, default).otherwise(s)


def safe_filename(c: Column, default: str = "translated", most: int = 120) -> Column:
    """A file name without the characters that file systems refuse, cut to ``most`` characters."""
    s = py_strip(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\\\/:*?"<>|\r\n\t]+', " "))
    s = F.substring(F.regexp_replace(F.regexp_replace(s, r"^\.+|\.+$", ""), f"{BLANK}+", " "), 1, most)
    return F.when(F.length(s) == 0, default).otherwise(s)


# Names of languages and their codes; names that tell nothing.
LANGUAGE_NAMES = {
    "ja": "japanese 日语 日文 jp jpn",
    "en": "english 英语 英文 eng",
    "ru": "russian 俄语 俄文 rus",
    "zh": "chinese 中文 汉语 zh-cn zho",
    "ko": "korean 韩语 韩文 kor",
    "fr": "french 法语 法文",
    "de": "german 德语 德文",
    "es": "spanish 西班牙语 西班牙文",
    "it": "italian 意大利语 意大利文",
    "pt": "portuguese 葡萄牙语 葡萄牙文",
}
UNTOLD = "auto unknown und uncertain mixed 多语言 未知".split()


def language_code(c: Column) -> Column:
    """A two-letter code of a language's name or tag; empty where it tells none."""
    name = F.lower(py_strip(F.coalesce(c, F.lit(""))))
    code = F.create_map(*[F.lit(x) for code, names in LANGUAGE_NAMES.items() for n in names.split() for x in (n, code)])
    two = F.substring(name, 1, 2)
    return F.when(name.isin(UNTOLD), "").otherwise(F.coalesce(F.try_element_at(code, name), F.when(two.rlike(r"^\p{L}+\z"), two).otherwise("")))


def epub_language(c: Column) -> Column:
    """The language tag of a book; Chinese and nothing are simplified Chinese."""
    tag = F.lower(F.replace(py_strip(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-")))
    return F.when(tag.isin("", "zh", "zh-cn", "zh-hans", "cn"), "zh-Hans").otherwise(c)


def base_name(href: Column) -> Column:
    """The file name of a link, without folder and fragment."""
    return F.regexp_extract(F.substring_index(F.coalesce(href, F.lit("")), "#", 1), r"[^/]*\z", 0)


def echoes_name(title: Column, href: Column, book: Column) -> Column:
    """Whether a title only repeats the file's stem or the title of the book."""
    stem = F.regexp_replace(F.regexp_extract(href, r"[^/]*\z", 0), r"\.[^.]*\z", "")
    t, b = py_strip(title), py_strip(F.coalesce(book, F.lit("")))
    return ((stem != "") & (t == stem)) | ((b != "") & (t == b))


def hit_rate(hit: Column, miss: Column) -> Column:
    """Share of hits, to four digits; 0 where there was nothing."""
    return F.when(hit + miss > 0, F.round(hit / (hit + miss), 4)).otherwise(F.lit(0.0))


def rescaled(offset: Column, source_length: Column, target_length: Column) -> Column:
    """An offset in a source text carried over to its target, rounded half to even, within the target."""
    to = F.bround(offset * target_length / source_length).cast("int")
    return F.when(source_length > 0, F.greatest(F.lit(0), F.least(to, target_length.cast("int")))).otherwise(F.lit(0))


def match_key(c: Column) -> Column:
    """Compatibility forms and case folded away (NFKC, then full case folding). Null stays null."""
    @F.arrow_udf("string")
    def key(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fold_text(t) for t in texts.to_pylist()], pa.string())

    return key(c)


def fold_text(text: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", text).casefold()
