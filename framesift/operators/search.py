"""Search over everything that a photo says: names, people, words, camera, subjects, date and place.

Texts are folded (lower case, without combining marks, by the rule of Unicode's
canonical decomposition) on both sides, and a query is looked for anywhere in
them. Subjects are also found by neighbouring words: a small dictionary whose
words begin the query or are begun by it. All of it is built-in expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expr import col

MARKS = range(0x300, 0x370)


def _folding() -> tuple[str, str]:
    """Letters that are a plain one with marks, and their plain ones; the marks themselves go."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and all(ord(x) in MARKS for x in d[1:]):
            pairs.append((c, d[0]))
    return "".join(a for a, _ in pairs) + "".join(map(chr, MARKS)), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def fold(c: str | Column) -> Column:
    return F.translate(F.lower(col(c)), FOLD_FROM, FOLD_TO)


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if ord(c) not in MARKS)


#: Words that people look for, and the subjects that are near them.
RELATED: dict[str, tuple[str, ...]] = {
    "zapada": ("snow", "ice", "winter", "skis", "snowboard", "sled"), "snow": ("snow", "ice", "winter", "skis", "snowboard", "sled"), "iarna": ("snow", "ice", "winter", "skis", "snowboard", "jacket"),
    "winter": ("snow", "ice", "winter", "skis", "snowboard", "jacket"), "ninsoare": ("snow", "ice", "winter"), "gheata": ("ice", "snow", "winter", "skating"), "schi": ("skis", "snowboard", "snow"), "sanie": ("sled", "snow"),
    "copil": ("person", "child", "boy", "girl", "baby"), "copii": ("person", "child", "boy", "girl", "baby"), "child": ("person", "child", "boy", "girl", "baby"), "bebelus": ("baby", "child", "person"),
    "familie": ("person", "child", "group"), "portret": ("person", "face", "portrait"), "oameni": ("person", "group", "crowd"), "people": ("person", "group", "crowd"),
    "animal": ("dog", "cat", "bird", "horse", "sheep", "cow", "bear", "zebra", "elephant", "giraffe"), "animale": ("dog", "cat", "bird", "horse", "sheep", "cow", "bear"),
    "caine": ("dog",), "catel": ("dog",), "pisica": ("cat",), "pasare": ("bird",), "cal": ("horse",),
    "mancare": ("food", "cake", "pizza", "sandwich", "donut", "hot dog", "bowl", "dining table", "banana", "apple", "orange"), "food": ("food", "cake", "pizza", "sandwich", "donut", "bowl", "dining table"),
    "tort": ("cake",), "desert": ("cake", "donut", "ice cream"), "masa": ("dining table", "food", "bowl", "cup"),
    "natura": ("tree", "plant", "grass", "leaf", "branch", "flower", "mountain", "sky"), "nature": ("tree", "plant", "grass", "leaf", "branch", "flower", "mountain", "sky"),
    "peisaj": ("mountain", "sky", "tree", "sea", "field", "landscape"), "munte": ("mountain", "snow", "sky"), "mare": ("sea", "beach", "boat", "water"), "plaja": ("beach", "sea", "umbrella", "water"),
    "padure": ("tree", "branch", "leaf", "plant"), "flori": ("flower", "plant", "vase"), "apus": ("sky", "sunset", "sun"), "cer": ("sky", "cloud"),
    "oras": ("building", "car", "street", "traffic light", "bus"), "masina": ("car", "truck", "vehicle"), "car": ("car", "truck", "vehicle"), "bicicleta": ("bicycle",), "vacanta": ("suitcase", "beach", "sea", "airplane", "mountain"),
    "craciun": ("christmas tree", "gift", "cake", "candle"), "nunta": ("person", "tie", "cake", "flower", "dress"), "petrecere": ("cake", "balloon", "wine glass", "bottle", "person"), "aniversare": ("cake", "candle", "balloon", "gift"),
    "acasa": ("couch", "bed", "chair", "tv", "potted plant", "dining table"), "birou": ("laptop", "keyboard", "mouse", "monitor", "chair"),
    "sport": ("sports ball", "tennis racket", "skateboard", "surfboard", "skis", "bicycle"),
}
#: Names of the months, long and short.
MONTHS = {
    "ro": (("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie"), ("ian.", "feb.", "mar.", "apr.", "mai", "iun.", "iul.", "aug.", "sept.", "oct.", "nov.", "dec.")),
    "en": (("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")),
}
NEAR = {"ro": "lângă ", "en": "near "}


def related(query: str) -> list[str]:
    """Subjects near a folded query of three letters at least."""
    if len(query) < 3:
        return []
    return list(dict.fromkeys(t for word, tags in RELATED.items() if word.startswith(query) or query.startswith(word) for t in tags))


def date_words(at_ms: str | Column, locale: str = "ro") -> Column:
    """Year, month (long and short) and day of a time, as people write them."""
    t = F.timestamp_millis(col(at_ms))
    long, short = (F.element_at(F.array(*[F.lit(m) for m in names]), F.month(t)) for names in MONTHS[locale])
    year, day = F.year(t).cast("string"), F.dayofmonth(t).cast("string")
    whole = F.concat(day, F.lit(" "), short, F.lit(" "), year) if locale == "ro" else F.concat(short, F.lit(" "), day, F.lit(", "), year)
    return F.coalesce(F.concat_ws(" ", year, long, short, whole), F.lit(""))


#: How far around its centre a place reaches: by its population, within limits; where nobody lives by the list, and where the list has no populations.
REACH, REACH_LEAST, REACH_MOST, REACH_UNKNOWN, REACH_PLAIN = 0.6, 1.5, 12.0, 3.0, 5.0


def place_radius_km(population: str | Column, listed: bool = True) -> Column:
    if not listed:
        return F.lit(REACH_PLAIN)
    p = col(population)
    return F.when(p <= 0, F.lit(REACH_UNKNOWN)).otherwise(F.least(F.lit(REACH_MOST), F.greatest(F.lit(REACH_LEAST), REACH * F.sqrt(p / 1000))))


def place_label(name: Column, country: Column, distance_km: Column, radius_km: Column, locale: str = "ro") -> Column:
    """A place with its country, or near it."""
    full = F.when(F.coalesce(country, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(", "), country))
    return F.when(distance_km <= radius_km, full).otherwise(F.concat(F.lit(NEAR[locale]), full))


def search_texts(columns: Iterable[str], labels: dict[str, str] | None = None, locale: str = "ro") -> Column:
    """The folded texts of a photo: those that the view has of file_name, project, caption, camera_make, camera, lens, place, persons, keywords, tags (by ``labels``, else as they are) and captured_at."""
    have = set(columns)
    one = [F.coalesce(fold(c), F.lit("")) for c in ("file_name", "project", "caption", "place") if c in have]
    camera = [c for c in ("camera_make", "camera", "lens") if c in have]
    if camera:
        one.append(fold(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in camera])))
    if "captured_at" in have:
        one.append(fold(date_words("captured_at", locale)))
    lists = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), fold) for c in ("persons", "keywords") if c in have]
    if "tags" in have:
        named = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else None
        word = (lambda t: fold(F.coalesce(F.try_element_at(named, t), t))) if labels else fold
        lists.append(F.transform("tags", word))
    return F.concat(F.array(*one) if one else F.array().cast("array<string>"), *lists)


def matches(query: str, texts: Column, tags: str | None = "tags") -> Column:
    """Is a query in some text, or is a subject near it among the tags. An empty query is in all."""
    q = folded(query)
    if not q:
        return F.lit(True)
    hit = F.exists(texts, lambda x: F.contains(x, F.lit(q)))
    near = related(q)
    return hit | F.coalesce(F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in near])), F.lit(False)) if tags and near else hit


#: Stands between the texts of a photo: in no query.
BETWEEN = "\0"


def searched_texts(columns: Iterable[str], labels: dict[str, str] | None = None, locale: str = "ro") -> Column:
    """What ``search_texts`` has, as one string with BETWEEN between the texts: folded once, and searched without a lambda for each query."""
    have = set(columns)
    one: list[Column] = [F.col(c) for c in ("file_name", "project", "caption", "place") if c in have]
    camera = [c for c in ("camera_make", "camera", "lens") if c in have]
    if camera:
        one.append(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in camera]))
    if "captured_at" in have:
        one.append(date_words("captured_at", locale))
    one += [F.col(c) for c in ("persons", "keywords") if c in have]
    if "tags" in have:
        named = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else None
        one.append(F.transform("tags", lambda t: F.coalesce(F.try_element_at(named, t), t)) if labels else F.col("tags"))
    return fold(F.concat_ws(BETWEEN, *one)) if one else F.lit("")


def found_in(query: str, texts: Column, tags: str | None = "tags") -> Column:
    """``matches`` on ``searched_texts``."""
    q = folded(query)
    if not q:
        return F.lit(True)
    if BETWEEN in q:
        return F.lit(False)
    near = related(q)
    hit = F.contains(texts, F.lit(q))
    return hit | F.coalesce(F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in near])), F.lit(False)) if tags and near else hit
