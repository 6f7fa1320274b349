"""File sources and sinks: photo files, metadata headers, places, backups, sidecars."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import round_half_up
from ..operators.filters import folder_tag

#: File extensions of camera raw formats.
RAW_EXTENSIONS = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "orf", "rw2", "pef", "ptx", "srw", "3fr", "erf", "kdc", "dcr", "mrw", "raw", "rwl", "iiq", "x3f")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "avif")

BACKUP = "version int, photos array<struct<id:string,fileName:string,capturedAt:bigint,status:string,rating:int>>, corrections array<struct<photoId:string,contextKey:string,aiDecision:boolean,userDecision:boolean,ts:bigint>>"
FEEDBACK = "photoId string, fileName string, verdict string, comment string"
PLACES = "name string, lat double, lon double, country string, population double"


def photo_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and kind of the files of a folder; kind is null for what is no photo. Unreadable files are skipped."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    return f.withColumn("kind", file_kind("path"))


def file_kind(path: str | Column) -> Column:
    e = F.lower(F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"\.([^./\\]+)$", 1))
    return F.when(e.isin(*IMAGE_EXTENSIONS), "image").when(e.isin(*RAW_EXTENSIONS), "raw")


def split_supported(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos, and one row with how many files were passed over."""
    return files.filter("kind is not null"), files.agg(F.count_if(F.col("kind").isNull()).alias("skipped"))


def sniff(content: str = "content") -> Column:
    """The real format by its first bytes."""
    h = F.hex(F.substring(content, 1, 16))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("61766966", "61766973"), "avif").when((F.substring(h, 9, 8) == "66747970") & F.substring(h, 17, 8).isin("68656963", "68656978", "6D696631"), "heic")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff").when(h.startswith("474946"), "gif").when(h.startswith("424D"), "bmp")
    )


EXIF = "make string, model string, lens string, taken_ms bigint, iso int, f_number double, exposure_s double, focal_mm double, focal_35mm int, orientation int, flash int, metering int, bias_ev double, white_balance int, software string, lat double, lon double, alt double, gps_error_m double"
#: Fixed values of the public TIFF and EXIF formats: tags by directory, and sizes of the field types.
TAGS = {0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0xA434: "lens", 0x9003: "taken", 0x8827: "iso", 0x829D: "f_number", 0x829A: "exposure_s", 0x920A: "focal_mm", 0xA405: "focal_35mm", 0x9209: "flash", 0x9207: "metering", 0x9204: "bias_ev", 0xA403: "white_balance", 0x0131: "software", 0x0132: "changed"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt", 0x1F: "gps_error_m"}
EXIF_IFD, GPS_IFD = 0x8769, 0x8825
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _directory(b: bytes, at: int, order: str, names: dict[int, str]) -> dict:
    """One TIFF directory as a dict; fields that run out of the buffer are left out."""
    out: dict = {}
    if at <= 0 or at + 2 > len(b):
        return out
    for i in range(struct.unpack_from(order + "H", b, at)[0]):
        p = at + 2 + 12 * i
        if p + 12 > len(b):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", b, p)
        size = SIZES.get(kind, 0) * n
        if tag not in names or not size:
            continue
        q = p + 8 if size <= 4 else struct.unpack_from(order + "I", b, p + 8)[0]
        if q + size > len(b):
            continue
        if kind == 2:
            out[names[tag]] = b[q : q + n].split(b"\0")[0].decode("latin-1").strip()
        elif kind in (5, 10):
            v = [a / d if d else 0.0 for a, d in struct.iter_unpack(order + ("II" if kind == 5 else "ii"), b[q : q + size])]
            out[names[tag]] = v[0] if n == 1 else v
        else:
            v = struct.unpack_from(order + {1: "B", 3: "H", 4: "I", 7: "B", 9: "i"}[kind] * n, b, q)
            out[names[tag]] = v[0] if n == 1 else list(v)
    return out


def _clock(text: str | None) -> int | None:
    """Milliseconds of a camera's "year:month:day hour:minute:second"."""
    try:
        when = datetime.strptime(text or "", "%Y:%m:%d %H:%M:%S").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return int(when.timestamp() * 1000) if when.year >= 1900 else None


def read_exif(b: bytes | None) -> dict | None:
    """The fields of EXIF of a JPEG or TIFF header; None if there are none."""
    if not b:
        return None
    base = -1
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(b) and b[at] == 0xFF:
            marker, size = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
            if marker == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
                base = at + 10
                break
            if marker == 0xDA:
                break
            at += 2 + size
    elif b[:4] in (b"II*\0", b"MM\0*"):
        base = 0
    if base < 0:
        return None
    t = b[base:]
    order = {b"II": "<", b"MM": ">"}.get(t[:2])
    if order is None or len(t) < 8:
        return None
    top = struct.unpack_from(order + "I", t, 4)[0]
    d = _directory(t, top, order, TAGS | {EXIF_IFD: "exif_at", GPS_IFD: "gps_at"})
    d |= _directory(t, d.get("exif_at", 0), order, TAGS)
    g = _directory(t, d.get("gps_at", 0), order, GPS_TAGS)
    out = {k: d.get(k) for k in ("make", "model", "lens", "f_number", "exposure_s", "focal_mm", "bias_ev", "software")}
    out |= {k: d[k] if isinstance(d.get(k), int) else None for k in ("iso", "focal_35mm", "orientation", "flash", "metering", "white_balance")}
    out["taken_ms"] = next((ms for name in ("taken", "changed") if (ms := _clock(d.get(name))) is not None), None)
    for k, minus in (("lat", "S"), ("lon", "W")):
        v = g.get(k)
        out[k] = (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if g.get(f"{k}_ref") == minus else 1) if isinstance(v, list) and len(v) == 3 else None
    out["alt"] = -g["alt"] if g.get("alt_ref") == 1 and "alt" in g else g.get("alt")
    out["gps_error_m"] = g.get("gps_error_m")
    return out


def exif(files: DataFrame, content: str = "content") -> DataFrame:
    """Add a struct ``exif``. Only the first 128 KiB of a file go to Python."""

    @F.pandas_udf(EXIF)
    def parse(head: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in EXIF.split(", ")]
        return pd.DataFrame([{n: (read_exif(b) or {}).get(n) for n in names} for b in head], columns=names)

    return files.withColumn("exif", parse(F.substring(content, 1, 131_072)))


#: Fixed values of the public IPTC-IIM format: datasets of record 2; and of the JPEG container that holds them.
IPTC_TAGS = {5: "title", 25: "keywords", 80: "author", 90: "city", 101: "country", 105: "headline", 110: "credit", 115: "source", 116: "copyright", 120: "caption"}
PHOTOSHOP, RESOURCE, IPTC_RESOURCE = b"Photoshop 3.0\0", b"8BIM", 0x0404


def _segments(b: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker and content of the segments of a JPEG before its picture."""
    at = 2 if b[:2] == b"\xff\xd8" else len(b)
    while at + 4 <= len(b) and b[at] == 0xFF and b[at + 1] not in (0xD9, 0xDA):
        if b[at + 1] == 0x01 or 0xD0 <= b[at + 1] <= 0xD8:  # markers alone
            at += 2
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        yield b[at + 1], b[at + 4 : at + 2 + size]
        at += 2 + size


def _resource(b: bytes, wanted: int) -> bytes | None:
    """The data of one resource among those of Photoshop's segment; names and data are padded to even lengths."""
    at = b.find(RESOURCE)
    while 0 <= at and at + 12 <= len(b):
        data = at + 7 + b[at + 6]
        data += (data - at) % 2
        size = int.from_bytes(b[data : data + 4], "big")
        if data + 4 + size > len(b):
            return None
        if int.from_bytes(b[at + 4 : at + 6], "big") == wanted:
            return b[data + 4 : data + 4 + size]
        at = b.find(RESOURCE, data + 4 + size)
    return None


def read_iptc(b: bytes | None) -> dict:
    """Datasets of record 2 in the IPTC resource of a JPEG; keywords are a list, an object name is the headline where there is none."""
    out: dict = {"keywords": []}
    block = next((r for marker, s in _segments(b or b"") if marker == 0xED and s.startswith(PHOTOSHOP) and (r := _resource(s[len(PHOTOSHOP) :], IPTC_RESOURCE)) is not None), b"")
    at = 0
    while at + 5 <= len(block):
        if block[at] != 0x1C:
            at += 1
            continue
        size, data = int.from_bytes(block[at + 3 : at + 5], "big"), at + 5
        if size & 0x8000:  # so many bytes hold the length
            more = size & 0x7FFF
            size, data = int.from_bytes(block[data : data + more], "big"), data + more
        if data + size > len(block):
            break
        name = IPTC_TAGS.get(block[at + 2]) if block[at + 1] == 2 else None
        value = block[data : data + size].decode("utf-8", "replace").strip()
        if name == "keywords":
            out["keywords"] += [value] if value else []
        elif name:
            out[name] = value
        at = data + size
    if out.get("title") and not out.get("headline"):
        out["headline"] = out["title"]
    return out


def iptc(files: DataFrame, content: str = "content") -> DataFrame:
    names = ["title", "author", "city", "country", "headline", "credit", "source", "copyright", "caption"]

    @F.pandas_udf(", ".join(f"{n} string" for n in names) + ", keywords array<string>")
    def parse(head: pd.Series) -> pd.DataFrame:
        rows = [read_iptc(b) for b in head]
        return pd.DataFrame({n: [r.get(n) for r in rows] for n in [*names, "keywords"]})

    return files.withColumn("iptc", parse(F.substring(content, 1, 131_072)))


def places(spark: SparkSession, path: str) -> DataFrame:
    """A gazetteer of tab-separated name, lat, lon, country and maybe population; lines that don't parse are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 4)
    num = lambda i: F.expr(f"try_cast(try_element_at(p, {i}) as double)")
    out = lines.select(F.element_at("p", 1).alias("name"), num(2).alias("lat"), num(3).alias("lon"), F.trim(F.element_at("p", 4)).alias("country"), F.coalesce(F.floor(F.greatest(num(5), F.lit(0.0)) + 0.5), F.lit(0)).alias("population"))
    return out.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def backup(spark: SparkSession, path: str) -> DataFrame:
    """Photos of a backup of version 1 or 2 (a line for each part of it); another version is an error."""
    b = spark.read.schema(BACKUP).json(path)
    ok = F.when(F.col("version").isin(1, 2), F.col("photos")).otherwise(F.raise_error(F.lit("not a backup of version 1 or 2")))
    return b.select(F.explode(ok).alias("p")).select("p.*")


def write_backup(photos: DataFrame, path: str) -> None:
    """Photos with a decision or a rating, a thousand in each line: parts of a backup of version 2."""
    p = photos.filter("status <> 'pending' or rating > 0")
    row = F.struct(F.col("id").cast("string").alias("id"), F.col("file_name").alias("fileName"), F.col("captured_at").alias("capturedAt"), "status", F.col("rating").cast("int").alias("rating"))
    p.groupBy(F.expr("id div 1000").alias("_part")).agg(F.collect_list(row).alias("photos")).select(F.lit(2).alias("version"), "photos").write.mode("overwrite").json(path)


def client_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Entries of client feedback, a line each; a bad one rejects the file."""
    return spark.read.schema(FEEDBACK).option("mode", "FAILFAST").json(path)


#: Characters that file and folder names can't have.
ILLEGAL = r'[\\/:*?"<>|]'


def folder_label(labels: dict[str, str] | None = None) -> Column:
    """Where a photo goes: its known persons in order (and whether there are others), strangers, its first subject (by ``labels``, else as it is), landscapes or details."""
    names = F.array_sort("persons")
    n = F.size("persons")
    said = F.when(n == 1, F.element_at(names, 1)).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(F.lit(0), n - 1)), ", "), F.lit(" și "), F.try_element_at(names, n)))
    said = F.concat(said, F.when(F.col("stranger_count") > 0, " și alții").otherwise(""))
    tag = folder_tag()
    word = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[tag], tag) if labels else tag
    word = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    clean = lambda c: F.coalesce(F.nullif(F.trim(F.regexp_replace(c, ILLEGAL, "-")), F.lit("")), F.lit("necunoscut"))
    return F.when(n > 0, clean(said)).when(F.col("face_count") > 0, "Necunoscuți").when(tag.isNotNull(), clean(word)).when(F.col("scene_type") == "landscape", "Peisaje").otherwise("Detalii")


#: Stars and label of a decision, where the user gave no stars; a rejected photo is -1 whatever it has.
STARS = {"selected": 5, "candidate": 3, "rejected": -1, "review": 0}
LABELS = {"selected": "Green", "candidate": "Blue", "rejected": "Red", "review": "Yellow"}
XMP = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:Iptc4xmpCore="http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/" xmlns:Iptc4xmpExt="http://iptc.org/std/Iptc4xmpExt/2008-02-29/" xmlns:fs="urn:framesift" xmp:Rating="%s" xmp:Label="%s"%s>%s</rdf:Description></rdf:RDF></x:xmpmeta>'
#: Words for a scene's meaning.
SCENE_WORDS = {"portrait": "Portret", "child_portrait": "Portret copil", "group": "Grup", "family_group": "Grup familie", "landscape": "Peisaj", "detail": "Detaliu"}


def xmp_escape(c: str | Column) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def score_keyword(score: str = "ai_score") -> Column:
    """The decade of a score: 'IA 80-89'; the last one is 90-99."""
    band = F.greatest(F.lit(0), F.least(F.lit(90), (F.floor(F.col(score) / 10) * 10).cast("long")))
    return F.concat(F.lit("IA "), band.cast("string"), F.lit("-"), (band + 9).cast("string"))


def sidecar_keywords(columns: Iterable[str]) -> Column:
    """The user's keywords, persons, the scene's meaning, tags, score, series and what the project says, each once."""
    have = set(columns)
    list_of = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in have else F.array().cast("array<string>")
    scene = F.create_map(*[F.lit(x) for kv in SCENE_WORDS.items() for x in kv])[F.col("scene_semantic")] if "scene_semantic" in have else F.lit(None).cast("string")
    series = F.when(F.coalesce("group_id", F.lit("")) != "", F.concat(F.lit("Serie "), F.col("group_id")))
    project = [F.concat(F.lit(f"{said}: "), F.nullif(F.col(n), F.lit(""))) for n, said in (("client", "Client"), ("event", "Event"), ("location", "Location")) if n in have]
    return F.array_distinct(F.concat(list_of("keywords"), list_of("persons"), F.array_compact(F.array(scene)), list_of("tags"), F.array_compact(F.array(score_keyword(), series, *project))))


def sidecar(columns: Iterable[str]) -> Column:
    """XMP text of a decided photo: stars, label, score, series, client, keywords, caption, what decided the score, location and event; null for a pending one.

    Columns that the view lacks (keywords, caption, factors, client, event, location) say nothing."""
    have = set(columns)
    text = lambda n: F.nullif(F.col(n), F.lit("")) if n in have else F.lit(None).cast("string")
    of = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("status")]
    tag = lambda before, c, after: F.coalesce(F.concat(F.lit(before), xmp_escape(c), F.lit(after)), F.lit(""))
    bag = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"<{name}><rdf:Bag>"), F.array_join(F.transform(items, lambda w: F.concat(F.lit("<rdf:li>"), xmp_escape(w), F.lit("</rdf:li>"))), ""), F.lit(f"</rdf:Bag></{name}>"))).otherwise("")
    alt = lambda name, c: tag(f'<{name}><rdf:Alt><rdf:li xml:lang="x-default">', c, f"</rdf:li></rdf:Alt></{name}>")
    stars = F.when((F.col("status") != "rejected") & (F.col("rating") > 0), F.col("rating").cast("int")).otherwise(of(STARS))
    attributes = F.concat(F.coalesce(F.concat(F.lit(' fs:AIScore="'), round_half_up("ai_score").cast("string"), F.lit('"')), F.lit("")), tag(' fs:SeriesId="', text("group_id"), '"'), tag(' fs:Client="', text("client"), '"'))
    factors = F.coalesce("factors", F.array().cast("array<string>")) if "factors" in have else F.array().cast("array<string>")
    inside = F.concat(bag("dc:subject", sidecar_keywords(have)), alt("dc:description", text("caption")), bag("fs:AIFactors", factors), tag("<Iptc4xmpCore:Location>", text("location"), "</Iptc4xmpCore:Location>"), alt("Iptc4xmpExt:Event", text("event")))
    return F.when(of(STARS).isNotNull(), F.format_string(XMP, stars.cast("string"), of(LABELS), attributes, inside))


def series_persons(photos: DataFrame) -> DataFrame:
    """group_id, everyone: the persons that any frame of a series knows, in order (a frame of a burst may miss a face that another has)."""
    each = photos.filter("coalesce(group_id, '') <> ''").select("group_id", F.explode("persons").alias("p")).distinct()
    return each.groupBy("group_id").agg(F.array_sort(F.collect_list("p")).alias("everyone"))


def sidecars(decided: DataFrame, library: DataFrame) -> DataFrame:
    """id, xmp of decided photos; whoever is known in a series is in all its frames. Frames of no series, that all have one group_id, stay out of the join."""
    d, in_series = decided.filter("status <> 'pending'"), "coalesce(group_id, '') <> ''"
    j = d.filter(in_series).join(series_persons(library.select("group_id", "persons")), "group_id", "left")
    j = j.withColumn("persons", F.coalesce("everyone", F.array_sort("persons"))).drop("everyone")
    both = j.unionByName(d.filter(f"not {in_series}").withColumn("persons", F.array_sort("persons")))
    return both.select("id", sidecar(both.columns).alias("xmp"))


def manifest(photos: DataFrame) -> DataFrame:
    """One JSON row for each thousand selected names (never one list of all)."""
    return photos.filter("status = 'selected'").select("file_name", F.expr("id div 1000").alias("part")).groupBy("part").agg(F.to_json(F.array_sort(F.collect_list("file_name"))).alias("names"))


def export_plan(photos: DataFrame) -> DataFrame:
    """Where each selected photo goes."""
    return photos.filter("status = 'selected'").select("id", "file_name", folder_label().alias("folder"))


def recap_plan(photos: DataFrame, frame_ms: int = 1800, fade_ms: int = 500, total_ms: int = 30_000) -> DataFrame:
    """id and start_ms of the frames of a recap that fit; photos: id, place (1, 2, ..)."""
    fit = 1 + max(0, (total_ms - frame_ms) // (frame_ms - fade_ms))
    return photos.filter(F.col("place") <= fit).select("id", ((F.col("place") - 1) * (frame_ms - fade_ms)).alias("start_ms"))


PERSON = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("embeddings", T.ArrayType(T.ArrayType(T.FloatType())))])


def persons(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PERSON).json(path)


def write_persons(persons_: DataFrame, path: str, most: int = 12) -> None:
    """Profiles with at most so many of their last vectors."""
    keep = F.slice("embeddings", F.greatest(F.lit(1), F.size("embeddings") - most + 1), F.lit(most))
    persons_.withColumn("embeddings", F.when(F.size("embeddings") > 0, keep).otherwise(F.col("embeddings"))).write.mode("overwrite").json(path)
