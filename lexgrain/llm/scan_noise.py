"""Text read from scanned pages: divided words, misread characters, running titles and page numbers, found and repaired.

1. Words of all texts are counted by form: how often at all, how often in small letters, how often outside scans. Forms with the
   same glyph skeleton (i, l, 1 and r are one stroke, n and u two, m and rn three, e is c, and so on) make a group; a form that is rare,
   stands in scans and shares its skeleton with a far more frequent form is a suspect.
2. Suspects are looked up where they stand: of the frequent forms, the one best supported by the words before and after wins;
   short suspects need that support. A form too rare for its share in scans to mean anything is a suspect wherever it stands, and
   needs that support from both sides there. A text counts as a scan if it is said to be one or shows it by divided words or page numbers.
3. Short lines, with numbers masked, are counted per file; what recurs in a file, in scans, is its running title. The forms of
   titles (rare words masked) that recur in many files also find titles that stand only once. A title may be misread itself; that
   is part of the title, so only words outside titles count as misread.
4. Lines are numbered, titles and page numbers leave, words divided at line ends are joined with the next line that is left, and
   SQL windows find where paragraphs begin; the lines of a paragraph become one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions.words import folded
from lexgrain.session import small, written

# Glyphs that scanners confuse, as strokes.
STROKES = {
    "i": "|", "l": "|", "1": "|", "r": "|", "!": "|", "í": "|", "n": "||", "u": "||", "h": "||", "m": "|||", "d": "c|", "k": "|c",
    "e": "c", "c": "c", "(": "c", "o": "o", "0": "o", "s": "s", "5": "s", "$": "s", "a": "a", "@": "a", "t": "t", "+": "t", "f": "f", "ſ": "f",
    "b": "6", "6": "6", "é": "6", "g": "q", "q": "q", "9": "q", "v": "v", "y": "v", "è": "è", "ë": "è",
}
_STROKES = str.maketrans(STROKES)
HYPHENS = "-‐‑¬\xad"
_DIVIDED = re.compile(rf"(?<=[^\W\d_])[{HYPHENS}][ \t]*\r?\n\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[@+$](?=[^\W_])|\((?=[^\W\d_]{2})(?![^()]*\)))*|[@+](?=[^\W\d_]{2})(?:[^\W_]|[@+](?=[^\W_]))+")
_ODD_INSIDE = re.compile(r"(?<![^\W_])[^\W\d_]?[a-zà-ÿ]+[0156@+ſ][a-zà-ÿ]{2,15}(?![^\W_])|(?<![^\W_])[^\W\d_]?[a-zà-ÿ]+\([a-zà-ÿ]{2,15}(?![^()\n]*\))(?![^\W_])")
_PAGE = re.compile(r"^(?:[\W_]*(?:p|pg|page|pagina|página|pág)?\s*[.:]?\s*\d{1,4}\s*(?:(?:/|sur|of|de|\|)\s*\d{1,4})?[\W_]*|[\W_]*[ivxl]{1,6}[\W_]*)$", re.IGNORECASE)
_BESIDE = re.compile(r"^\s*\d{1,3}\s+(?:[—–|·-]\s*)?(?=[^\W\d])|(?<=[\w)])\s+(?:[—–|·-]\s*)?\d{1,3}\s*$")
_SEPARATED = re.compile(r" [–—•/·] ")
BITS = 23
#: Up to so many occurrences, a form's share in scans means nothing.
FEW = 2
_OWN_SIGNS = rf"(?m)\p{{L}}[{HYPHENS}][ \t]*\r?\n\s*\p{{Ll}}|^[ \t]*(?:[-–—·] ?\d{{1,4}} ?[-–—·]|[Pp](?:age|\.) ?\d{{1,4}}(?: ?(?:/|sur|of|de) ?\d{{1,4}})?)[ \t]*\r?$"


def skeleton(word: str) -> str:
    return word.lower().translate(_STROKES)


def is_page_number(line: str) -> bool:
    """A line that holds only the number of a page. A number with a full stop after it is a list's."""
    plain = line.encode("ascii", "ignore").decode().strip() if not line.isascii() else line.strip()
    if not plain or re.fullmatch(r"\d+[.)]", plain):
        return False
    if re.fullmatch(r"[\W_]*[ivxl]{1,6}[\W_]*", plain, re.IGNORECASE) and not re.fullmatch(r"[\W_]*(?:x{0,3}(?:ix|iv|v?i{0,3}))[\W_]*", plain):
        return False
    return bool(_PAGE.match(plain)) and any(c.isalnum() for c in plain)


def joined(text: str) -> str:
    """The text with words divided at line ends put together, for counting."""
    return _DIVIDED.sub("", text)


def _spots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def word_forms(texts: DataFrame) -> DataFrame:
    """``form, n, small, sound``: occurrences of each word form in lower case; written in small letters; outside scans. texts: ``text, scan``."""

    def count(batches):
        held: dict[str, list[int]] = {}

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *[pa.array([v[k] for v in held.values()], pa.int64()) for k in range(3)]], names=["form", "n", "small", "sound"])

        for batch in batches:
            for text, scan in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in _WORD.findall(joined(text)):
                    low = w.lower()
                    v = held.get(low)
                    if v is None:
                        v = held[low] = [0, 0, 0]
                    v[0] += 1
                    v[1] += low == w
                    v[2] += not scan
            if len(held) > 300_000:
                yield flush()
                held = {}
        yield flush()

    got = texts.mapInArrow(count, "form string, n long, small long, sound long")
    return got.groupBy("form").agg(*[F.sum(c).alias(c) for c in ("n", "small", "sound")])


def suspects(forms: DataFrame, ratio: float, least: int, sound_share: float) -> DataFrame:
    """``form, better, often, unsure, named``: rare forms of scans, and each frequent form of the same skeleton. unsure: so rare that it is
    a suspect although it stands outside what is taken for scans. named: the frequent form is mostly written with a capital, as names
    are, which differ by a stroke without being misread: good enough only for mending a text known to be misread."""

    def stroke(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([skeleton(w) for w in batch.column(0).to_pylist()], pa.string())], names=["form", "n", "small", "sound", "bones"])

    kinds = "form string, n long, small long, sound long, bones string"
    every = written(forms.where(F.length("form") >= 2).mapInArrow(stroke, kinds), "forms")
    letters = F.col("form").rlike(r"^\p{L}+$")
    often = every.where((F.col("n") >= least) & letters).select("bones", F.col("form").alias("better"), F.when(F.col("small") >= least, F.col("small")).otherwise(F.col("n")).alias("often"), (F.col("small") < least).alias("named"))
    outside = F.col("sound") > sound_share * F.col("n")
    rare = every.where(~outside | (F.col("n") <= FEW)).select("bones", "form", "n", outside.alias("unsure"))
    return rare.join(often, "bones").where((F.col("form") != F.col("better")) & (F.col("often") >= ratio * F.col("n"))).select("form", "better", "often", "unsure", "named")


def _bitmap(words: DataFrame, name: str) -> np.ndarray:
    """A 1 MB map of the words of a column; at most 2**23 numbers reach the driver, whatever the corpus."""

    def at(batches):
        for batch in batches:
            spots = np.unique(_spots(_hash(batch.column(0).to_pylist()))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots)], names=["at"])

    bits = np.zeros(1 << BITS, bool)
    bits[words.select(name).distinct().mapInArrow(at, "at long").distinct().toPandas()["at"].to_numpy(np.int64)] = True
    return np.packbits(bits)


def misread_words(texts: DataFrame, kind: str, ratio: float = 10.0, least: int = 12, sound_share: float = 0.25) -> DataFrame:
    """``key, form, better, context, sure``: suspects where they stand, with the form they should have. texts: ``key, text, scan``.

    sure: certain enough to tell that the text was misread at all. In a text that was, the others are taken for misread too.
    """
    spark = texts.sparkSession
    table = written(suspects(word_forms(texts.select("text", "scan")), ratio, least, sound_share), "suspects")
    maps = spark.sparkContext.broadcast((_bitmap(table, "form"), _bitmap(table, "better")))

    def look(batches):
        bad, good = maps.value
        known: dict[str, int] = {}

        def kinds(words: list[str]) -> list[int]:
            new = [w for w in set(words) if w not in known]
            if new:
                if len(known) > 300_000:
                    known.clear()
                    new = list(set(words))
                at = _spots(_hash(new))
                side = 7 - (at & 7).astype(np.uint8)
                for w, b, g in zip(new, ((bad[at >> 3] >> side) & 1).tolist(), ((good[at >> 3] >> side) & 1).tolist()):
                    known[w] = b + 2 * g
            return [known[w] for w in words]

        pairs: dict[tuple[str, str], int] = {}
        for batch in batches:
            row, before, form, after = [], [], [], []
            scans = batch.column(2).to_pylist()
            for i, text in enumerate(batch.column(1).to_pylist()):
                w = [x.lower() for x in _WORD.findall(joined(text))]
                what = kinds(w)
                for j, k in enumerate(what):
                    if k & 1:
                        row.append(i)
                        before.append(w[j - 1] if j else "")
                        form.append(w[j])
                        after.append(w[j + 1] if j + 1 < len(w) else "")
                    if k & 2 and not scans[i]:
                        if j:
                            pairs[w[j - 1], w[j]] = pairs.get((w[j - 1], w[j]), 0) + 1
                        if j + 1 < len(w):
                            pairs[w[j], w[j + 1]] = pairs.get((w[j], w[j + 1]), 0) + 1
            keys = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(before, pa.string()), pa.array(form, pa.string()), pa.array(after, pa.string()), pa.array([0] * len(row), pa.int64())], names=["key", "before", "form", "after", "n"])
            if len(pairs) > 300_000:
                yield counted(batch, pairs)
                pairs = {}
        if pairs:
            yield counted(batch, pairs)

    def counted(batch, pairs):
        none = pa.nulls(len(pairs), batch.column(0).type)
        return pa.RecordBatch.from_arrays([none, pa.array([p[0] for p in pairs], pa.string()), pa.nulls(len(pairs), pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["key", "before", "form", "after", "n"])

    seen = written(texts.select("key", "text", "scan").mapInArrow(look, f"key {kind}, before string, form string, after string, n long"), "seen")
    pairs = seen.where("form is null").groupBy("before", "after").agg(F.sum("n").alias("n"))
    spots = seen.where("form is not null").select("key", "before", "form", "after").distinct()
    offered = spots.join(table, "form")
    left = pairs.select("before", F.col("after").alias("better"), F.col("n").alias("l"))
    right = pairs.select(F.col("before").alias("better"), "after", F.col("n").alias("r"))
    told = offered.join(left, ["before", "better"], "left").join(right, ["better", "after"], "left").withColumn("context", F.coalesce("l", F.lit(0)) + F.coalesce("r", F.lit(0)))
    told = told.withColumn("sure", ~F.col("named") & (~F.col("unsure") | (F.col("l").isNotNull() & F.col("r").isNotNull())))
    value = F.struct("context", "often", "better")
    best = told.groupBy("key", "before", "form", "after").agg(F.max(F.when(F.col("sure"), value)).alias("b"), F.max(value).alias("any"))
    picked = F.coalesce("b", "any")
    sure = F.col("b").isNotNull() & ((F.length("form") > 4) | (F.col("b.context") > 0))
    return best.select("key", "form", picked["better"].alias("better"), picked["context"].alias("context"), sure.alias("sure"))


def _title_tokens(line: str) -> tuple[list[str], bool]:
    """The tokens of a line as skeletons, numbers masked, and whether a page number stands beside it."""
    bare = _BESIDE.sub("", line)
    out = []
    for t in folded(bare).split():
        core = t.strip("()[]«».,;:")
        out.append("#" if core.isdigit() else skeleton(core) if any(c.isalnum() for c in core) else t)
    return out, bare != line


def short_lines(texts: DataFrame, kind: str, longest: int = 64) -> DataFrame:
    """``key, file, scan, line, tokens, beside``: lines that could be a running title."""

    def cut(batches):
        for batch in batches:
            row, lines, tokens, beside = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for line in dict.fromkeys(text.split("\n")):
                    s = line.strip()
                    if not 6 <= len(s) <= longest or s[-1] in ";,:!?" or (s[-1] == "." and not _SEPARATED.search(s)) or "\t" in s or " ; " in s or s.count(" | ") > 1 or is_page_number(s):
                        continue
                    t, b = _title_tokens(line.rstrip("\r"))
                    if 2 <= len(t) <= 13 and not t[0] in ("-", "*", "–", "•", "—") and sum(len(x) > 2 for x in t) >= 1:
                        row.append(i)
                        lines.append(line)
                        tokens.append(t)
                        beside.append(b)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(lines, pa.string()), pa.array(tokens, pa.list_(pa.string())), pa.array(beside, pa.bool_())], names=["key", "file", "scan", "line", "tokens", "beside"])

    return texts.select("key", "file", "text", "scan").mapInArrow(cut, f"key {kind}, file string, scan boolean, line string, tokens array<string>, beside boolean")


_MARKS = ("–", "—", "•", "/", "·")


def _shapes(tokens: list[str], known: list[bool]) -> list[str]:
    """The forms of a title with rare words masked: the whole, its first two words, what follows its separator."""
    m = [t if k else "*" for t, k in zip(tokens, known)]
    squeeze = lambda x: [t for i, t in enumerate(x) if t != "*" or i == 0 or x[i - 1] != "*"]
    out = [" ".join(squeeze(m))]
    if m[0] != "*" and m[1] != "*":
        out.append(f"{m[0]} {m[1]} …")
    at = next((i for i, t in enumerate(m) if t in _MARKS), 0)
    if 0 < at < len(m) - 1:
        out.append("… " + " ".join(squeeze(m[at:])))
    return [x for x in dict.fromkeys(out) if not re.fullmatch(r"(?:… \S )?[*#]", x)]


def running_titles(texts: DataFrame, kind: str, common: int = 8, scan_share: float = 0.7, again_share: float = 0.2) -> DataFrame:
    """``key, line, beside``: the running titles standing in the texts. texts: ``key, file, text, scan``.

    Files, titles and shapes travel as 64-bit numbers.
    """
    spark = texts.sparkSession
    same = F.xxhash64("file", F.array_join("tokens", " "))
    lines = written(short_lines(texts, kind).withColumn("id", same).withColumn("f", F.xxhash64("file")).drop("file"), "short-lines")
    each = lines.groupBy("id", "key").agg(F.first("f").alias("f"), F.first("tokens").alias("tokens"), F.max("scan").cast("double").alias("scan"))
    once = each.groupBy("id").agg(F.first("f").alias("f"), F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.avg("scan").alias("scans"))
    titles = written(once, "titles")
    token_files = titles.select("f", F.explode("tokens").alias("t")).distinct().groupBy("t").agg(F.count("*").alias("files")).where(F.col("files") >= common)
    # each token is looked up itself; the frequent ones are sent to the tasks only if they are counted to be few
    spread = titles.select("id", F.posexplode("tokens").alias("i", "t")).join(small(token_files.select("t", F.lit(True).alias("known"))), "t", "left")
    masked = spread.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "t", F.coalesce("known", F.lit(False)).alias("known")))).alias("tokens"))  # at most 13

    def shape(batches):
        for batch in batches:
            row, out = [], []
            for i, own in enumerate(batch.column(1).to_pylist()):
                made = _shapes([x["t"] for x in own], [x["known"] for x in own])
                row += [i] * len(made)
                out += made
            take = pa.array(row, pa.int64())
            numbers = _hash(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take), pa.array(numbers)], names=["id", "f", "n", "scans", "shape"])

    placed = masked.join(titles.select("id", "f", "n", "scans"), "id").select("id", "tokens", "f", "n", "scans")
    shapes = written(placed.mapInArrow(shape, "id long, f long, n long, scans double, shape long"), "shapes")
    by_file = shapes.groupBy("shape", "f").agg(F.sum("n").alias("n"), F.sum(F.col("scans") * F.col("n")).alias("s"), F.max("n").alias("most"))
    told = by_file.groupBy("shape").agg(F.count("*").alias("files"), (F.sum("s") / F.sum("n")).alias("scans"), F.avg((F.col("most") >= 2).cast("double")).alias("again"))
    good = told.where((F.col("scans") >= scan_share) & (F.col("files") >= 3) & (F.col("again") >= again_share))
    found = shapes.join(good.select("shape"), "shape").select("id").unionByName(titles.where((F.col("n") >= 3) & (F.col("scans") >= scan_share)).select("id")).distinct()
    return lines.select("id", "key", "line", "beside").join(found, "id").select("key", "line", "beside").distinct()


def _body(lines: list[str], titles: set[str]) -> list[str]:
    """The lines that are neither blank nor a page number nor a title."""
    return [x for x in lines if x.strip() and x not in titles and not is_page_number(x)]


def line_noise(texts: DataFrame, kind: str, titles: DataFrame, words: DataFrame) -> DataFrame:
    """``key, noise_kind``: hyphens, page numbers and characters by line; titles and words: those already known for the text.

    A misread word counts where it stands outside titles, and as a whole: the halves of a word divided across a title are none.
    """
    known = titles.groupBy("key").agg(F.collect_set("line").alias("titles"), F.max("beside").alias("beside"))
    forms = words.where("sure").groupBy("key").agg(F.collect_set("form").alias("forms"))
    facts = texts.select("key", "text").join(known.join(forms, "key", "full_outer"), "key", "left").select("key", "text", "titles", "beside", "forms")

    def find(batches):
        for batch in batches:
            row, what = [], []
            for i, (text, own, beside, forms) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)))):
                kinds = set()
                body = text
                if "\n" in text:
                    own = set(own or ())
                    lines = text.split("\n")
                    if own:
                        kinds.add("header")
                    left = _body(lines, own)
                    if beside or (len(left) < len(lines) and any(is_page_number(x) for x in lines)):
                        kinds.add("page_number")
                    if any(divided(a, b) for a, b in zip(left, left[1:])):
                        kinds.add("hyphen")
                    body = "\n".join(left) if forms or own else text
                elif own:
                    kinds.add("header")
                    body = ""
                if _ODD_INSIDE.search(body) or (forms and not {x.lower() for x in _WORD.findall(joined(body))}.isdisjoint(forms)):
                    kinds.add("chars")
                for k in kinds:
                    row.append(i)
                    what.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(what, pa.string())], names=["key", "noise_kind"])

    return facts.mapInArrow(find, f"key {kind}, noise_kind string")


_END = re.compile(rf"([^\W_]+)([{HYPHENS}])\s*$")


def divided(line: str, later: str) -> bool:
    """A word divided at the end of the line: a hyphen-like mark after a letter, continued in small letters. A written hyphen
    (as in "-t-on") that happens to stand at the end is none."""
    m = _END.search(line)
    rest = later.lstrip()
    if not m or not rest or not m.group(1)[-1].isalpha() or not (rest[0].isalpha() and rest[0].islower()):
        return False
    if m.group(2) == "-":
        if re.match(r"t-(?:on|il|elle)s?\b", rest) or (line[: m.start(1)].endswith("-") and m.group(1) == "t"):
            return False
        if re.match(r"(?:on|il|elle|ils|elles|ce|je|tu|nous|vous|là|ci)\b", rest) and re.search(r"(?:-t|[^\W_]{2,})$", line[: m.end(1)]) and line[: m.end(1)].endswith(("-t",)):
            return False
    return True


def scan_noise(rows: DataFrame, key: str, content: str, file: str, scan: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kinds: ``key, noise_kind``; words: ``key, form, better, context, sure``; titles: ``key, line, beside``).

    scan: whether a text is said to be read from a scan; it may be wrong or null, as a text's own signs count as much. Null texts
    and keys are left out; repeated rows of a key count once; rows with a null file share one. Empty tables give no rows.
    """
    kind = dict(rows.dtypes)[key]
    texts = rows.where(F.col(key).isNotNull() & F.col(content).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(file).cast("string"), F.lit("")).alias("file"), F.col(content).alias("text"), (F.coalesce(scan, F.lit(False)) | F.col(content).rlike(_OWN_SIGNS)).alias("scan"))
    words = written(misread_words(texts, kind), "words")
    titles = written(running_titles(texts, kind), "titles")
    return line_noise(texts, kind, titles, words).distinct(), words, titles


def repaired(rows: DataFrame, key: str, content: str, file: str, scan: Column) -> DataFrame:
    """``key, kinds, content``: every noisy text as continuous paragraphs, with the kinds of noise that were found.

    One row for each key with noise (of several texts of one key, the greatest). Tables and lists keep their lines.
    """
    kinds, words, titles = scan_noise(rows, key, content, file, scan)
    kind = dict(rows.dtypes)[key]
    kinds = written(kinds, "kinds")
    found = kinds.groupBy("key").agg(F.sort_array(F.collect_set("noise_kind")).alias("kinds"))
    # in a text with misread words, every suspect is mended, by its skeleton alone where the context is silent
    misread = kinds.where("noise_kind = 'chars'").select("key")
    chosen = words.where("length(form) > 2 or context > 0").join(misread, "key", "left_semi")
    fixes = chosen.groupBy("key", "form").agg(F.max_by("better", F.struct("sure", "context")).alias("better")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("form", "better"))).alias("fixes"))
    own = titles.groupBy("key").agg(F.collect_set("line").alias("titles"))
    text = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(content).alias("text")).join(found, "key")
    lines = text.join(own, "key", "left").select("key", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), F.posexplode(F.split("text", "\n")).alias("i", "line"))

    def mark(batches):
        for batch in batches:
            page = [is_page_number(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([p or x in t for p, x, t in zip(page, batch.column(3).to_pylist(), batch.column(1).to_pylist())])], names=["key", "i", "line", "drop"])

    marked = lines.mapInArrow(mark, f"key {kind}, i int, line string, drop boolean").where("not drop")
    by = Window.partitionBy("key").orderBy("i")
    blank = F.trim("line") == ""
    item = F.col("line").rlike(r"^\s*(?:[-*•–—]\s|\w{1,3}[.)/]\s)") | F.col("line").rlike(r"\t| \| | ; .* ; ")
    cut = F.coalesce(F.lag("line").over(by), F.lit("")).rlike(rf"[^\W_][{HYPHENS}]\s*$")
    flagged = marked.withColumn("blank", blank).withColumn("cut", cut).where("not (blank and cut)")
    kept = flagged.withColumn("gap", F.lag("blank").over(by)).withColumn("text_before", F.last(F.when(~F.col("blank"), F.col("line")), True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    begin = item | (F.coalesce("gap", F.lit(True)) & F.coalesce(F.col("text_before").rlike(r"[.!?:»”\"|]\s*$"), F.lit(True))) | F.coalesce(F.col("text_before").rlike(r"\t| \| | ; .* ; "), F.lit(False))
    numbered = kept.where("not blank").withColumn("p", F.sum(begin.cast("int")).over(by))
    paragraphs = numbered.groupBy("key", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: F.rtrim(x["line"])), "\n").alias("line"))
    whole = paragraphs.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n\n").alias("text"))

    def mend(batches):
        for batch in batches:
            out = []
            for found, text, fix in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = _DIVIDED.sub("", text)
                text = re.sub(r"(?<!\n)\n(?!\n)", " ", text)
                text = _WORD.sub(lambda m, f=dict(fix or ()): _like(m.group(), f.get(m.group().lower())), text)
                out.append(_ODD_INSIDE.sub(lambda m: with_letters(m.group()), text) if "chars" in found else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["key", "kinds", "content"])

    both = found.join(whole, "key", "left").join(fixes, "key", "left").select("key", "kinds", F.coalesce("text", F.lit("")).alias("text"), "fixes")
    return both.mapInArrow(mend, f"key {kind}, kinds array<string>, content string").withColumnRenamed("key", key)


# The letter that a sign inside a word most often is; a 6 begins words as b and stands in them as é.
LETTER_OF = {"0": "o", "1": "l", "5": "s", "@": "a", "+": "t", "(": "c", "ſ": "f", "6": "é"}
_LETTER_OF = str.maketrans(LETTER_OF)


def with_letters(word: str) -> str:
    """A word that no known form explains, with letters for the signs in it."""
    return word[:1] + word[1:].translate(_LETTER_OF)


def _like(word: str, better: str | None) -> str:
    """The better form in the capitals of the word."""
    if not better:
        return word
    if word.isupper() and len(word) > 1:
        return better.upper()
    return better.capitalize() if word[0].isupper() else better


def _p2_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/chunks.parquet").select("chunk_id", "source_file", "content", "extraction_method", "reliability")


def _scan() -> Column:
    return F.lower("extraction_method").startswith("ocr")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The kinds of scan noise in the content of chunks."""
    kinds, _, _ = scan_noise(_p2_rows(spark, folder), "chunk_id", "content", "source_file", _scan())
    return kinds.select(F.col("key").alias("chunk_id"), "noise_kind")


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The noisy contents as continuous paragraphs."""
    return repaired(_p2_rows(spark, folder), "chunk_id", "content", "source_file", _scan()).select("chunk_id", F.array_join("kinds", ",").alias("kinds"), "content")


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL: dict[str, str] = {}
