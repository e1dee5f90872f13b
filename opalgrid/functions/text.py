"""Answer parsing, names, ordinals, templates and prompts as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    """First match as a number, null if there is none or it is too long to be an identifier."""
    return F.expr("try_cast(null as bigint)") if c is None else F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("bigint")


#: The ways an answer is written.
STRICT_TAG, TOLERANT_TAG, ALTERNATIVE = r"<answer>(\d+)</answer>", r"(?i)<answer>\s*(\d+)\s*</answer>", r"(?i)answer[:\s]+(\d+)"
ID_HINT = r"(?i)\bID\b[^0-9]{0,12}(\d+)"


def answer_strict(c: Column) -> Column:
    return F.coalesce(_number(c, STRICT_TAG), _number(c, ALTERNATIVE))


def answer_tolerant(c: Column) -> Column:
    return F.coalesce(_number(c, TOLERANT_TAG), _number(c, ALTERNATIVE))


def answer_cascade(c: Column) -> Column:
    """Tag, alternative, last identifier hint, the only number of the text."""
    hints = F.regexp_extract_all(c, F.lit(ID_HINT), F.lit(1))
    last = F.when(F.size(hints) > 0, F.element_at(hints, -1)).try_cast("bigint")
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\b(\d+)\b"), F.lit(1)), lambda x: x.try_cast("bigint")))
    only = F.when(F.size(numbers) == 1, F.element_at(numbers, 1))
    return F.coalesce(answer_tolerant(c), last, only)


def answer_tag(c: Column) -> Column:
    """A response reduced to its tag; 0 where nothing can be read."""
    return F.concat(F.lit("<answer>"), F.coalesce(answer_cascade(c), F.lit(0)).cast("string"), F.lit("</answer>"))


def warned(c: Column, token: str = "[WARN]") -> Column:
    return F.contains(c, F.lit(token))


def name_key(c: Column) -> Column:
    """Trimmed, lower case, single spaces."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def name_tight(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def mentions(description: Column, name: Column) -> Column:
    """Whether a class is named in a description, spaces aside."""
    return F.contains(name_tight(description), name_tight(name)) & (F.length(name_tight(name)) > 0)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def safe_class_dir(number: Column, name: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit("_"), F.regexp_replace(name, r"[^A-Za-z0-9_-]+", "_"))


def detector_name(path: Column, known: dict[str, str], default: str = "unknown") -> Column:
    """First known substring of the path, in order."""
    out = F.lit(default)
    for part, name in reversed(known.items()):
        out = F.when(F.contains(F.lower(path), F.lit(part)), F.lit(name)).otherwise(out)
    return out


def clean_label(c: Column) -> Column:
    """Without parentheses and their content; underscores and runs of spaces become one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", ""), "_", " "), r" {2,}", " "))


def after_slash(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def class_of(label: Column, names: Column) -> Column:
    """Name of a label in a map, else class_<label>."""
    return F.coalesce(F.element_at(names, label), F.concat(F.lit("class_"), label.cast("string")))


# Chinese digits, and the class names of a remote-sensing vocabulary with their translations.
DIGITS = "一二三四五六七八九"
CHINESE = {
    "airplane": "飞机",
    "airport": "机场",
    "baseballfield": "棒球场",
    "basketballcourt": "篮球场",
    "bridge": "桥梁",
    "chimney": "烟囱",
    "dam": "水坝",
    "expressway service area": "高速公路服务区",
    "expressway toll station": "高速公路收费站",
    "golffield": "高尔夫球场",
    "groundtrackfield": "田径场",
    "harbor": "港口",
    "overpass": "立交桥",
    "ship": "舰船",
    "stadium": "体育场",
    "storagetank": "储罐",
    "tenniscourt": "网球场",
    "trainstation": "火车站",
    "vehicle": "车辆",
    "windmill": "风车",
}


def ordinal_zh(n: Column) -> Column:
    """第一个 ... 第九十九个; other numbers keep their figures."""
    digits = F.array(*[F.lit(d) for d in DIGITS])
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    one = F.when(ones > 0, F.element_at(digits, F.greatest(ones, F.lit(1)))).otherwise(F.lit(""))
    ten = F.when(tens > 1, F.element_at(digits, F.greatest(tens, F.lit(1)))).otherwise(F.lit(""))
    word = F.when(n < 10, F.element_at(digits, F.greatest(F.least(n, F.lit(9)), F.lit(1)).cast("int"))).otherwise(F.concat(ten, F.lit("十"), one))
    return F.concat(F.lit("第"), F.when((n >= 1) & (n <= 99), word).otherwise(n.cast("string")), F.lit("个"))


def bilingual(name: Column, words: dict[str, str] = CHINESE) -> Column:
    """name（中文）where the vocabulary knows it."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), F.trim(name))
    return F.when(found.isNull(), name).otherwise(F.concat(name, F.lit("（"), found, F.lit("）")))


def migrate_bilingual(question: Column, words: dict[str, str] = CHINESE) -> Column:
    """Class names in a question made bilingual, longest first, unless that was done before."""
    for name in sorted(words, key=lambda n: (len(n), n), reverse=True):
        question = F.regexp_replace(question, f"{name}(?!（)", f"{name}（{words[name]}）")
    return question


TEMPLATES = {
    "zh": ("在图中，", "对应的目标编号是多少？"),
    "en": ("In this image, which marker ID corresponds to: ", "? Answer with <answer>ID</answer>."),
    "where": ("Where is the ", "?"),
}


def question(text: Column, dialect: str = "en") -> Column:
    before, after = TEMPLATES[dialect]
    return F.concat(F.lit(before), F.trim(text), F.lit(after))


def expected_answer(marker: Column) -> Column:
    return F.concat(F.lit("<answer>"), marker.cast("string"), F.lit("</answer>"))


def prompt(names: Column, separator: str = " . ") -> Column:
    """Detector prompt ``a . b .`` of an array of names."""
    return F.concat(F.array_join(F.transform(names, clean_label), separator), F.lit(" ."))


def prompt_spans(names: Column, separator: str = " . ") -> Column:
    """[begin, end) of each name in prompt(names)."""
    gap = len(separator)
    clean = F.transform(names, clean_label)
    step = lambda acc, n: F.struct((acc["at"] + F.length(n) + gap).cast("int").alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("b"), (acc["at"] + F.length(n)).cast("int").alias("e")))).alias("spans"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int>>").alias("spans"))
    return F.aggregate(clean, start, step, lambda acc: acc["spans"])


def prompt_names(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\."), lambda x: F.trim(x)), lambda x: x != "")


def chunks(names: Column, n: int) -> Column:
    """An array cut into arrays of at most n."""
    count = F.ceil(F.size(names) / n).cast("int")
    return F.when(F.size(names) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(names, i * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def phrase_of(caption: Column, spans: Column) -> Column:
    """Text of token spans (struct<b, e>); neighbouring words are joined by one space."""
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda s: F.substring(caption, s["b"] + 1, s["e"] - s["b"])), " ")


def word_bucket(c: Column) -> Column:
    """Length class of a description, in words."""
    n = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return F.when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 9, "7-9").otherwise("10+")


def caption_ok(c: Column, forbidden: tuple[str, ...] = ("<", ">", "http", "\n"), most: int = 240) -> Column:
    """ASCII, none of the forbidden tokens, fewer than ``most`` words."""
    clear = functools.reduce(lambda a, b: a & b, [~F.contains(c, F.lit(t)) for t in forbidden])
    return c.isNotNull() & clear & ~c.rlike(r"[^\x00-\x7F]") & (F.size(F.split(F.trim(c), r"\s+")) < most)


def data_url(content: Column, path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    mime = F.when(suffix == "png", "image/png").when(suffix == "webp", "image/webp").when(suffix == "bmp", "image/bmp").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def palette_index(name: Column, n: int = 32) -> Column:
    """A colour number from the first 32 bits of the name's MD5."""
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def hue(label: Column) -> Column:
    return (label * 37) % 180
