"""Predicates and filters over the photo view. Each is a column or a DataFrame -> DataFrame function; Catalyst joins the conjunctions and pushes them down."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import blank_to_null, uncertainty
from .search import matches, search_texts

TEXT_DOMINANT = 0.15
#: Columns of the photo view that a saved filter searches.
SEARCHED = ("file_name", "project", "camera", "persons", "tags", "captured_at")
SHARP_LOW, SHARP_ALTERNATIVE = 45, 60
#: Below this share of open eyes a frame with faces has a defect.
EYES_OPEN = 0.8
SELECT_AT, REJECT_AT = 65, 35
#: How file names of screenshots and screen recordings begin.
SCREENSHOT_PREFIXES = ("screenshot", "screen_shot", "screnshot", "captura", "capture_", "scrn", "screenrecord", "screen_record")
DECIDED = ("selected", "rejected", "candidate")
#: Tags of ideas, clothes, gestures and matter, which are no subject and name no folder.
ABSTRACT_TAGS = (
    "selfie", "photograph", "snapshot", "photography", "vacation", "fun", "leisure", "recreation", "interaction", "smile", "facial expression", "happy", "eyewear", "glasses",
    "skin", "hairstyle", "beard", "human body", "muscle", "gesture", "standing", "sitting", "walking", "running", "t-shirt", "shirt", "shorts", "jeans", "dress", "jacket", "coat",
    "hat", "cap", "shoe", "sneakers", "clothing", "fashion", "sportswear", "uniform", "baby", "child", "toddler", "family", "friendship", "team", "crowd", "group", "people",
    "portrait", "forehead", "chin", "cheek", "nose", "eyebrow", "eyelash", "jaw", "neck", "ear", "lip", "tooth", "facial hair", "mustache", "long hair", "blond hair", "black hair",
    "wrinkle", "headgear", "sunglasses", "earrings", "necklace", "jewellery", "ring", "bracelet", "watch", "makeup", "formal wear", "suit", "blazer", "sweater", "hoodie", "scarf",
    "glove", "sock", "belt", "boot", "sandal", "high heels", "swimwear", "bikini", "costume", "wedding dress", "pajamas", "jumping", "dancing", "singing", "laughing", "crying",
    "kissing", "hugging", "waving", "posing", "sleeping", "eating", "drinking", "reading", "writing", "playing", "pattern", "texture", "wood", "metal", "glass", "plastic",
    "fabric", "textile", "leather", "silk", "cotton", "wool", "denim", "lace", "love", "romance", "adventure", "freedom", "meditation", "yoga", "wellness", "health", "medicine",
    "education", "learning", "business", "work", "meeting", "conference", "teamwork", "success", "number", "letter", "symbol", "icon", "emblem", "badge", "stamp", "coin",
    "currency", "map", "chart", "graph", "diagram", "calendar", "newspaper", "magazine", "font", "logo", "product", "electronics", "technology", "text",
)


def is_decided(status: str = "status") -> Column:
    return F.col(status).isin(*DECIDED)


def user_status(names: list[str]) -> Column:
    return F.col("status").isin(*names)


def bulk_reject_targets(photos: DataFrame, threshold: int) -> DataFrame:
    return photos.filter(~is_decided() & (F.col("ai_score") < threshold))


def date_between(low: int, high: int, at: str = "captured_at") -> Column:
    """Inclusive at both ends; no date counts as 0."""
    return F.coalesce(F.col(at), F.lit(0)).between(low, high)


def has_person(name: str) -> Column:
    return F.array_contains("persons", name)


def has_tag(tag: str) -> Column:
    return F.array_contains("tags", tag)


def color_is(label: str) -> Column:
    return F.coalesce("color_label", F.lit("none")) == label


def in_project(name: str | None) -> Column:
    own = blank_to_null("project")
    return own.isNull() if name is None else own == name


def matches_search(query: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """What search.py finds in these columns of a view."""
    return matches(query, search_texts(columns), "tags" if "tags" in columns else None)


@dataclass(frozen=True)
class Preset:
    """A saved filter: what is not set does not narrow."""

    status: tuple[str, ...] = ()
    person: str | None = None
    tag: str | None = None
    camera: str | None = None
    color: str | None = None
    project: str | None = None
    min_rating: int = 0
    dates: tuple[int, int] | None = None
    search: str = ""
    extra: tuple[Column, ...] = field(default=())

    def predicate(self) -> Column:
        p = F.lit(True)
        for wanted, own in ((self.status, lambda: user_status(list(self.status))), (self.person, lambda: has_person(self.person)), (self.tag, lambda: has_tag(self.tag)), (self.camera, lambda: F.col("camera") == self.camera), (self.color, lambda: color_is(self.color)), (self.project, lambda: in_project(self.project)), (self.min_rating > 0, lambda: F.col("rating") >= self.min_rating), (self.dates, lambda: date_between(*self.dates)), (self.search, lambda: matches_search(self.search))):
            if wanted:
                p = p & own()
        for e in self.extra:
            p = p & e
        return p


def filtered(photos: DataFrame, preset: Preset) -> DataFrame:
    return photos.filter(preset.predicate())


def screen_like() -> Column:
    ratio = F.greatest("width", "height") / F.least("width", "height")
    return F.coalesce((F.least("width", "height") > 0) & ratio.between(1.7, 2.4), F.lit(False))


def inbox_category(name: str = "file_name") -> Column:
    """'screenshot', 'document' or 'personal'."""
    base = F.lower(F.trim(F.regexp_extract(name, r"([^/\\]*)$", 1)))
    text = F.coalesce("text_coverage", F.lit(0.0))
    named = F.lit(False)
    for p in SCREENSHOT_PREFIXES:
        named = named | base.startswith(p)
    tagged = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0
    return F.when(named, "screenshot").when(F.col("face_count") > 0, "personal").when((text >= 0.3) & screen_like(), "screenshot").when((text >= 0.12) & ~tagged, "document").otherwise("personal")


def sensitive_documents(photos: DataFrame, private: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Text-dominated photos that are neither in the vault nor dismissed (tables of id)."""
    return photos.filter(F.col("text_coverage") >= TEXT_DOMINANT).join(private, "id", "left_anti").join(dismissed, "id", "left_anti")


def protects(names: list[str]) -> Column:
    return F.arrays_overlap("persons", F.array(*[F.lit(n) for n in names]))


def subject_rank() -> Column:
    """3 known person, 2 people, 1 other, 0 document."""
    return F.when(F.col("text_coverage") >= TEXT_DOMINANT, 0).when(F.coalesce("known_face_count", F.lit(0)) > 0, 3).when(F.coalesce("face_count", F.lit(0)) > 0, 2).otherwise(1)


def effective_sharpness() -> Column:
    """Frames without faces are judged on a curve that is lenient to soft landscapes."""
    s = F.col("sharpness").cast("double")
    return F.when(F.col("face_count") > 0, s).otherwise(F.pow(F.greatest(F.lit(0.0), s) / 100, F.lit(0.6)) * 100)


def eyes_open() -> Column:
    """Share of faces with open eyes: the group's, else all or none."""
    return F.coalesce(F.col("group_eyes_open").cast("double"), F.col("all_eyes_open").cast("double"))


def folder_tag(tags: str = "tags") -> Column:
    """The first tag that is a subject; null if there is none."""
    known = F.filter(tags, lambda t: ~F.lower(t).isin(*ABSTRACT_TAGS))
    return F.try_element_at(known, F.lit(1))


def has_defect(sharpness: Column | None = None) -> Column:
    s = effective_sharpness() if sharpness is None else sharpness
    return (
        (s < SHARP_LOW) | (F.abs(F.col("exposure") - 50) > 15) | (F.coalesce("highlight_clipping", F.lit(0.0)) > 0.06)
        | (F.coalesce("shadow_clipping", F.lit(0.0)) > 0.06) | F.coalesce(~F.col("subject_in_focus"), F.lit(False)) | ((F.col("face_count") > 0) & (eyes_open() < EYES_OPEN))
    )


def decide_status(score: str = "ai_score", select_at: int = SELECT_AT, reject_at: int = REJECT_AT, sharpness: Column | None = None) -> Column:
    """The order matters: reject only what has a defect and no known person, select only what has a subject in focus."""
    subject = ~((F.coalesce("text_coverage", F.lit(0.0)) >= TEXT_DOMINANT) | ((F.col("face_count") == 0) & folder_tag().isNull()))
    soft = F.coalesce(~F.col("subject_in_focus"), F.lit(False))
    return F.when((F.col(score) <= reject_at) & (F.col("known_face_count") == 0) & has_defect(sharpness), "rejected").when((F.col(score) >= select_at) & subject & ~soft, "selected").otherwise("review")


def rating_decision() -> Column:
    return F.when(F.col("rating") >= 4, True).when(F.col("rating").between(1, 2), False)


def scene_of(largest: str | Column = "largest_face") -> Column:
    """Scene from faces and aspect; of two faces, the larger one's share of the frame decides."""
    n, big = F.col("face_count"), F.col(largest) if isinstance(largest, str) else largest
    return F.when(n >= 3, "group").when(n == 2, F.when(big > 0.04, "portrait").otherwise("group")).when(n == 1, "portrait").when(F.col("width") >= F.col("height"), "landscape").otherwise("detail")


def excluded_folder(name: str = "folder") -> Column:
    """Folders that hold screenshots, downloads or messenger media."""
    return F.lower(F.col(name)).rlike("screenshot|download|whatsapp|telegram|messenger|screen ?record")


def deletable(photos: DataFrame) -> DataFrame:
    """Rejected photos, with whether the store knows where they are."""
    return photos.filter("status = 'rejected'").withColumn("deletable", F.coalesce(F.col("media_uri") != "", F.lit(False)))


def stale(last: Column, now: Column, days: float) -> Column:
    """A reminder is due: nothing yet, or longer ago than so many days (times in ms)."""
    return last.isNull() | (now - last >= F.lit(int(days * 86_400_000)))


def reading_order(name: str) -> Column:
    """A key by which names sort as in a dictionary: letters first, then accents, then small before capital ones."""
    return F.collate(F.col(name), "UNICODE")


def uncertain(score: str = "ai_score", least: float = 0.5) -> Column:
    return uncertainty(score) >= least
