"""Column expressions over entry names: folding, extension, kind, match quality, natural order."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Extensions of each kind code.
KIND_EXTENSIONS = {
    3: "pdf doc docx xls xlsx ppt pptx pages numbers key txt md markdown rtf rtfd csv tsv epub mobi odt ods odp tex log",
    4: "png jpg jpeg gif heic heif webp bmp tiff tif svg psd ai sketch fig raw cr2 cr3 nef arw dng ico icns avif",
    5: "mp4 mov mkv avi wmv flv webm m4v mpg mpeg 3gp rmvb",
    6: "mp3 wav flac aac m4a ogg wma aiff aif opus mid midi caf",
    7: "swift c h m mm cpp hpp cc js jsx mjs cjs ts tsx py rb go rs java kt php html htm css scss less vue svelte astro sh zsh "
    "bash json yaml yml toml xml sql lua dart cs r pl gradle plist ipynb",
    8: "zip rar 7z tar gz bz2 xz tgz zst dmg iso pkg jar war apk ipa",
}
#: Words for the kind codes 1 to 8 in a search line.
KIND_NAMES = ("folder", "app", "doc", "image", "video", "audio", "code", "archive")
#: Directory extensions that make a package, and directory names whose contents are noise.
PACKAGES = (
    "app bundle framework plugin kext appex xpc prefpane qlgenerator mdimporter saver component vst vst3 photoslibrary "
    "musiclibrary tvlibrary fcpbundle imovielibrary xcodeproj xcworkspace playground xcarchive dsym rtfd scptd lproj logicx "
    "band screenstudio pages numbers key"
).split()
NOISE = (
    "node_modules .git .svn .hg __pycache__ .venv venv site-packages Pods DerivedData .gradle .npm .pnpm-store .yarn .cache "
    ".cargo .rustup .Trash Caches Cache .next .nuxt bower_components .idea .build .swiftpm CMakeFiles .tox .mypy_cache "
    ".pytest_cache .terraform"
).split()
SYSTEM = "System private usr bin sbin opt Library cores".split()
#: Characters that have a syllable in Latin letters, and the range's name in regular expressions.
HAN_FIRST, HAN_LAST, HAN = 0x4E00, 0x9FFF, r"[\x{4E00}-\x{9FFF}]"
#: How syllables are spelt: without marks, whatever else is left out below.
_SPELLING = "Han-Latin; NFD; [:Mn:] Remove; NFC"
_syllables: dict[str, list[str]] = {}


def syllables(spark: SparkSession) -> list[str]:
    """The syllable of each character from HAN_FIRST to HAN_LAST in letters a to z, by the ICU library that Spark brings.

    Made once an application, on the driver: a list of fixed length.
    """
    app = spark.sparkContext.applicationId
    if app not in _syllables:
        spelt = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(_SPELLING).transliterate("\n".join(map(chr, range(HAN_FIRST, HAN_LAST + 1))))
        _syllables.clear()
        _syllables[app] = [re.sub("[^a-z]", "", x.lower()) for x in spelt.split("\n")]
    return _syllables[app]


def syllable_table(spark: SparkSession) -> Column:
    """`syllables` as one array for all rows: a subquery, so plans do not spell it out."""
    return spark.createDataFrame(pa.table({"syllables": pa.array([syllables(spark)], pa.list_(pa.string()))})).scalar()


ASCII_LOWER = str.maketrans(UPPER, LOWER)


def fold(x: Column) -> Column:
    """A-Z to a-z; nothing else changes case."""
    return F.translate(x, UPPER, LOWER)


def extension(name: Column) -> Column:
    """Folded text after the last dot if it is 1 to 8 ASCII characters, else empty."""
    return fold(F.regexp_extract(name, r"\.([\x00-\x2D\x2F-\x7F]{1,8})$", 1))


def is_package(name: Column) -> Column:
    """Whether a folder of this name is a package: by all that follows its last dot, however long."""
    return name.contains(".") & fold(F.substring_index(name, ".", -1)).isin(PACKAGES)


def kind(name: Column, is_dir: Column) -> Column:
    """0 other, 1 folder, 2 app, 3 document ... 8 archive."""
    ext = extension(name)
    out = F.when(is_dir & (ext == "app"), 2).when(is_dir & ~is_package(name), 1)
    for code, exts in KIND_EXTENSIONS.items():
        out = out.when(ext.isin(exts.split()), code)
    return out.otherwise(0)


def decoded_size(size: Column) -> Column:
    """Sizes from 2 GiB on are kept in steps of 4096 bytes."""
    big = F.least(F.shiftright(size, 12), F.lit(0x7FFFFFFF)) * 4096
    return F.when(size < 2**31, size).otherwise(big)


def alternate_keys(name: Column, table: Column) -> Column:
    """Further search keys of a name with characters above ASCII: syllables and initials if it has Han characters, else its lower case.

    table is a column that `syllable_table` fills. All that is no Han character stays, A-Z folded.
    """
    chars = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))

    def spelt(size: int | None) -> Column:
        def one(c: Column) -> Column:
            syllable = F.get(table, F.ascii(c) - HAN_FIRST)
            return F.when(c.rlike(HAN), syllable if size is None else F.left(syllable, F.lit(size))).otherwise(fold(c))

        return F.array_join(F.transform(chars, one), "")

    none = F.array().cast("array<string>")
    low = F.lower(name)
    return (
        F.when(~name.rlike(r"[^\x00-\x7F]"), none)
        .when(name.rlike(HAN), F.array(spelt(None), spelt(1)))
        .when(low != fold(name), F.array(low))
        .otherwise(none)
    )


def boundary_pattern(needle: str) -> str:
    """Where a needle starts a word inside a name; needs no look-behind."""
    first, rest, quoted = needle[0], re.escape(needle[1:]), re.escape(needle)
    parts = [rf"[ _.(\[+,-](?i:{quoted})"]
    if first in LOWER:
        parts += [rf"[a-z]{first.upper()}(?i:{rest})", rf"[0-9](?i:{quoted})"]
    elif first.isascii() and first.isdigit():
        parts.append(rf"[A-Za-z](?i:{quoted})")
    elif not first.isascii():
        parts.append(rf"[\x00-\x7F](?i:{quoted})")
    return "|".join(parts)


def match_quality(name: Column, folded: Column, needle: str) -> Column:
    """4 the name up to its only dot, 3 beginning, 2 start of a word, 1 elsewhere, 0 none."""
    if not needle:
        return F.lit(0)
    rest = F.substring(name, len(needle) + 1, 2**31 - 1)
    whole = folded.startswith(needle) & (F.length(rest) == 0) | folded.startswith(needle) & rest.rlike(r"^\.[^.]*$")
    return (
        F.when(whole, 4)
        .when(folded.startswith(needle), 3)
        .when(folded.contains(needle), F.when(name.rlike(boundary_pattern(needle)), 2).otherwise(1))
        .otherwise(0)
    )


def natural_key(folded: Column) -> Column:
    """A string whose byte order compares digit runs by value, then by length."""

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 4, "0"), digits, F.lpad(F.length(run).cast("string"), 4, "0"))
        return F.when(run.rlike("^[0-9]"), number).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(folded, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), key), "")


def glob_regex(pattern: str) -> str:
    """`*` any text, `?` one character, all else itself; the whole string must match."""
    return "(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def recency_sql(mtime: str, now: int) -> str:
    """Points for age at `now` (seconds), as SQL; a time to come counts as age 0."""
    return f"CASE WHEN {now} - {mtime} <= 86400 THEN 60 WHEN {now} - {mtime} <= 604800 THEN 45 WHEN {now} - {mtime} <= 2592000 THEN 30 WHEN {now} - {mtime} <= 31536000 THEN 10 ELSE 0 END"


def recency(mtime: str, now: int) -> Column:
    return F.expr(recency_sql(mtime, now))


def listed_extensions(x: Column) -> Column:
    """Extensions in a text, apart by blanks or commas: without dots, folded to lower case, once each."""
    parts = F.transform(F.split(x, r"[\s,\x{FF0C}]+"), lambda p: F.lower(F.regexp_replace(p, r"^\.+|\.+$", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def shell_quoted(x: Column) -> Column:
    """A text as one word of a shell command."""
    return F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def version_key(x: Column) -> Column:
    """Numbers of a dotted version, for comparing; what is no number counts as 0."""
    return F.transform(F.split(F.regexp_replace(x, "^[vV]", ""), r"\."), lambda p: F.coalesce(F.regexp_extract(p, "^[0-9]+", 0).try_cast("int"), F.lit(0)))
