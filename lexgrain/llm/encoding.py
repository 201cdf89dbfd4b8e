"""Text decoded with the wrong code page: found and restored as a substitution cipher learned per source.

A symbol is a maximal run of non-ASCII characters. A swap of code pages is a cipher from letters to symbols; which of the
possible ones a source suffers from, and which symbols are simply meant, is unknown.
1. The language model: how often each letter of the corpus's languages is written, and between which neighbours (bigrams to the
   left and to the right), counted over all texts; capitals borrow from small letters.
2. Expectation-maximization over all texts: the share of each swap among the occurrences, and how often each symbol stands for
   itself. A symbol that none of the languages writes prefers, as itself, no neighbours. Swaps nobody uses fade to nothing.
3. The same per source, starting from the common shares, with every other swap possible too: rows of a source are aggregated by
   symbol and neighbours first. A swap that the corpus as a whole does not show is taken for one of a source by the evidence
   within that source alone, however large the rest is.
4. Symbols of a source that no language writes and no known swap explains may come from a page outside the list: which letter
   each of them stands for is then learned from that source by EM against the bigrams (``Model.learned``), one letter for each symbol.
5. A field is garbled if, over all its doubtful symbols, some swap of its source explains them better than they themselves do.
   What each swap gains is worked out where the text is read, so only fields with something to gain leave that pass.
6. Restoring: symbols better explained by the field's swap are replaced by their letters (translate() of single-byte pages and of
   learned ones, run by run for UTF-8, also twice); the exact check is that the swap, done again, gives the symbol. Where another
   field of the row holds the same passage unharmed, it is taken from there, lost characters included; else those stay.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators.skew import join_facts
from lexgrain.session import written

# What French, English, Spanish and Portuguese write beyond ASCII.
LETTERS = "àâäæçèéêëîïôöœùûüÿñáíóúãõ"
MARKS = "«»–—‘’“”…•°ºª¿¡€"
WIDE = "utf-8"
SINGLE = ["cp1252", "mac_roman", "cp850", "cp437", "cp1250", "iso8859_15"]
LOST = "�"
_RUN = re.compile(r"[^\x00-\x7f]+")
_CLASSES = " abcdefghijklmnopqrstuvwxyz0^'.-(ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WIDTH = len(_CLASSES)
_SMALL, _LARGE = slice(1, 27), slice(_WIDTH - 26, _WIDTH)


def _context(ch: str) -> int:
    """The class of a neighbour: letters by case, digits, line edge, other marks."""
    if "a" <= ch <= "z":
        return ord(ch) - 96
    if "A" <= ch <= "Z":
        return ord(ch) - 65 + _WIDTH - 26
    if ch in " \t\xa0":
        return 0
    if ch.isdigit():
        return 27
    if ch in "\r\n" or not ch:
        return 28
    return {"'": 29, "-": 31, "(": 32, '"': 32, "[": 32}.get(ch, 30)


def _bytes_to_text(raw: bytes, page: str, drop: bool = False) -> str:
    """Decoded as sloppy programs do: undefined bytes pass as control characters, or are dropped."""
    out = []
    for b in raw:
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            ch = chr(b)
        if drop and "\x7f" < ch < "\xa0":
            continue
        out.append(ch)
    return "".join(out)


def _swaps() -> list[tuple[str, str, str]]:
    """(name, true encoding, wrong decoding) of all swaps considered."""
    out = [(f"{WIDE}>{w}", WIDE, w) for w in ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250"]]
    out += [(f"{a}>{b}", a, b) for a in SINGLE for b in [*SINGLE, "latin-1"] if a != b]
    return out


def garble(text: str, true: str, wrong: str, drop: bool = False) -> str:
    """The text as it reads after the swap; characters the true encoding lacks become question marks."""
    return _bytes_to_text(text.encode(true, "replace"), wrong, drop)


def _ways() -> dict[str, tuple]:
    """name -> the function that garbles a text by that swap."""
    out: dict[str, tuple] = {}
    for name, true, wrong in _swaps():
        out[name] = lambda c, t=true, w=wrong: garble(c, t, w)
        if true == WIDE:
            out[name + ">dropped"] = lambda c, t=true, w=wrong: garble(c, t, w, True)
            out[name + ">again"] = lambda c, t=true, w=wrong: garble(garble(c, t, w), t, w)
    return out


WAYS = _ways()
LANGUAGE = list(dict.fromkeys(c for c in LETTERS + LETTERS.upper() + MARKS if len(c) == 1))


def _ciphers() -> dict[str, dict[str, str]]:
    """swap -> symbol -> the letter that the swap turns into it."""
    out: dict[str, dict[str, str]] = {}
    for name, way in WAYS.items():
        own: dict[str, str] = {}
        for c in LANGUAGE:
            g = way(c)
            if g and g != c and all(ord(x) > 127 for x in g):
                own.setdefault(g, c)
        out[name] = own
    return out


CIPHERS = _ciphers()
NAMES = list(CIPHERS)
_AT = {c: i for i, c in enumerate(LANGUAGE)}
_COUNTED = set(LANGUAGE).union(*CIPHERS.values())


#: A symbol with the characters beside it; the text has a null character put before and after it.
_SYMBOL = re.compile(r"(?s)(?<=(.))([^\x00-\x7f]+)(?=(.))")


class _Classes(dict):
    """character -> the class of it as a neighbour."""

    def __missing__(self, ch: str) -> int:
        self[ch] = k = _context(ch)
        return k


_CLASS = _Classes({"\0": _context("")})


def _raw(text: str | None) -> Counter:
    """(character before, symbol, character after) -> occurrences."""
    return Counter(_SYMBOL.findall(f"\0{text}\0")) if text and not text.isascii() else Counter()


def _raws(texts: list[str | None]) -> list[Counter]:
    """The symbols of each field of a row. A later field that is the first one under other lines takes over its count."""
    first = texts[0]
    out = [_raw(first)]
    for text in texts[1:]:
        at = len(text) - len(first) if text and first else 0
        if at == 0 and text and text == first:
            out.append(out[0])
        elif at > 0 and text[at - 1] == "\n" and text.endswith(first):
            own = _raw(text[:at])
            for s, n in out[0].items():
                own[s] += n
            out.append(own)
        else:
            out.append(_raw(text))
    return out


#: How often a letter must be written to speak for a swap, or else its share of all symbols (in small corpora).
ATTESTED, ATTESTED_SHARE = 20, 1e-4
#: Where the corpus shows no such swap: its share to begin with in a source, and what must tell it there: ln of the odds, symbols, kinds of symbols.
RARE, TOLD, SYMBOLS, KINDS = 1e-6, 20.0, 5.0, 2
#: For a page outside the list: ln of the odds that its symbols stand as letters do, symbols between different neighbours, kinds of symbols.
LEARNED_TOLD, LEARNED_SPOTS, LEARNED_KINDS = 25.0, 12, 3
_WORDLY = {k for k in range(_WIDTH) if _CLASSES[k].isalpha()}
LEARNED = "learned"


class Model:
    """The language model, the share of each swap, and how often each symbol stands for itself."""

    def __init__(self, counts: dict[tuple[str, int, int], int], rounds: int = 60) -> None:
        model, total = np.zeros((len(LANGUAGE), _WIDTH, _WIDTH)), np.zeros((_WIDTH, _WIDTH))
        often: dict[str, float] = {}
        for (g, left, right), n in counts.items():
            total[left, right] += n
            often[g] = often.get(g, 0) + n
            if g in _AT:
                model[_AT[g], left, right] += n
        every = max(1.0, total.sum())
        self._lend_to_capitals(model)
        each = model.sum((1, 2))
        one = ((model.sum(2) + 0.02) / (each + 0.02 * _WIDTH)[:, None])[:, :, None] * ((model.sum(1) + 0.02) / (each + 0.02 * _WIDTH)[:, None])[:, None, :]
        self.joint = (model + 20.0 * one) / (each + 20.0)[:, None, None]
        self.plain = ((total.sum(1) + 1)[:, None] * (total.sum(0) + 1)[None, :]) / ((total.sum() + _WIDTH) ** 2)
        self.often = {c: often.get(c, 0) / every for c in LANGUAGE}
        self.attested = {c for c in LANGUAGE if often.get(c, 0) >= min(ATTESTED, ATTESTED_SHARE * every)}
        rows = list(counts)
        n = np.array([counts[r] for r in rows], float)
        symbols = sorted({r[0] for r in rows})
        place = {g: i for i, g in enumerate(symbols)}
        at = np.array([place[r[0]] for r in rows], int)
        own = np.array([self._own(*r) for r in rows])
        swap = np.array([self._swapped(*r) for r in rows]).reshape(len(rows), len(NAMES))
        self.itself = {g: often[g] / every * (0.5 if len(g) == 1 and not "\x7f" < g < "\xa0" else 1e-3) for g in symbols}
        q = np.array([self.itself[g] for g in symbols])
        share = np.append(0.95, np.full(len(NAMES), 0.05 / len(NAMES)))
        start, alive = q.copy(), np.ones(len(NAMES) + 1)
        of = np.array([[LANGUAGE.index(c) if (c := CIPHERS[name].get(g)) else -1 for name in NAMES] for g in symbols]).reshape(len(symbols), len(NAMES))
        for k in range(3 * rounds if len(rows) else 0):
            post = np.concatenate([(q[at] * own)[:, None], swap], 1) * (share * alive)
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            mass = n @ post
            share = (mass + 1e-3) / (mass + 1e-3).sum()
            q = np.bincount(at, weights=n * post[:, 0], minlength=len(symbols)) / max(mass[0], 1e-9)
            if k in (rounds, 2 * rounds):  # a swap that garbles only what is rarely written is no swap: begin again without it
                told: list[int] = []
                for j in np.argsort(-mass[1:], kind="stable"):
                    # judged by the symbols that no stronger swap explains in the same way
                    alone = {g: c for g, c in CIPHERS[NAMES[j]].items() if all(CIPHERS[NAMES[i]].get(g) != c for i in told)}
                    got = np.zeros(len(LANGUAGE))
                    seen = np.array([symbols[i] in alone for i in at])
                    np.add.at(got, of[at[seen], j], (n * post[:, 1 + j])[seen])
                    meant = np.array([self.often[c] if c in alone.values() else 0.0 for c in LANGUAGE])
                    main = int(meant.argmax())
                    if not alive[1 + j] or got[main] / max(got.sum(), 1e-9) < 0.2 * meant[main] / max(meant.sum(), 1e-12) or got.sum() < 1:
                        alive[1 + j] = 0.0
                    else:
                        told.append(int(j))
                q, share = start.copy(), np.append(0.95, np.full(len(NAMES), 0.05 / len(NAMES)))
        self.itself = {g: float(max(v, 1e-9)) for g, v in zip(symbols, q)}
        self.share = np.where(np.append(True, share[1:] >= 2e-5), share * alive, 0.0)
        self.marks = {g: np.array([CIPHERS[name].get(g, "") in MARKS for name in NAMES]) for g in symbols}
        self.active_at = np.flatnonzero(self.share[1:] > 0)
        self.active = [NAMES[i] for i in self.active_at]

    @staticmethod
    def _lend_to_capitals(model: np.ndarray) -> None:
        """A capital is rare, so half of what is known of it comes from its small letter: at a word's start, or among capitals."""
        for c in LANGUAGE:
            if c.lower() != c and c.lower() in _AT:
                small, own = model[_AT[c.lower()]], model[_AT[c]]
                lent = small.copy()
                raised = np.zeros_like(small)
                raised[_LARGE, _LARGE] = small[_SMALL, _SMALL]
                raised[_LARGE, : _LARGE.start] = small[_SMALL, : _LARGE.start]
                raised[_LARGE, _SMALL] = 0
                raised[: _LARGE.start, _LARGE] = small[: _LARGE.start, _SMALL]
                raised[_SMALL, _LARGE] = 0
                lent[_SMALL] = 0
                for x in (lent, raised):
                    if x.sum():
                        own += x * (max(own.sum(), 1.0) / x.sum())

    def source_share(self, seen: list[tuple[str, int, int, int]], weight: float, rounds: int = 5) -> np.ndarray | None:
        """The share of each swap in a source of ``(symbol, left, right, n)``; None if nothing there tells of a swap."""
        common = self.__dict__.setdefault("_common", self.doubtful())
        known: dict = self.__dict__.setdefault("_rows", {})
        table: list = self.__dict__.setdefault("_ratios", [])
        if len(known) > 200_000:
            known.clear()
            table.clear()
        names, at, n, plain = [], [], [], 0
        for g, left, right, k in seen:
            i = known.get((g, left, right))
            if i is None:
                r = self.ratios(g, left, right)
                if g in common or r.max() >= 1:
                    table.append(r)
                    i = len(table) - 1
                else:
                    i = -1
                known[g, left, right] = i
            if i < 0:
                plain += k
            else:
                names.append(g)
                at.append(i)
                n.append(k)
        if not names:
            return None
        r, n = np.concatenate([np.ones((len(at), 1)), np.array([table[i] for i in at])], 1), np.array(n, float)
        begin = np.where(self.share > 0, self.share, RARE)
        still = plain * (np.arange(len(begin)) == 0)
        for again in range(2):
            share = begin
            for _ in range(rounds):
                post = r * share
                post /= post.sum(1, keepdims=True)
                share = (begin * weight + n @ post + still) / (weight + n.sum() + plain)
            if not again:
                keep = self.share > 0
                # judged by the symbols that no swap known to the corpus explains as well; swaps unknown to it that explain
                # a symbol alike share what it tells, so of each counts all that is not the symbol itself
                best = r[:, 1:].max(1, keepdims=True)
                met = (r[:, 1:] * keep[1:]).max(1, keepdims=True) >= 0.2 * best
                near = np.where((r >= 0.2 * best) & ~met, 1 - post[:, :1], 0.0)
                for j in np.flatnonzero(~keep & (n @ near >= SYMBOLS)):
                    keep[j] = self._told(names, r[:, j], near[:, j], j - 1)
                if (keep == (begin > 0)).all():
                    break
                begin = np.where(keep, begin, 0.0)
        return share

    def learned(self, seen: list[tuple[str, int, int, int]], rounds: int = 30) -> dict[str, str]:
        """symbol -> letter for a source of ``(symbol, left, right, n)`` whose page is not in the list; empty if nothing tells of one.

        Expectation-maximization of a free mapping: a symbol's occurrences between their neighbours are explained by the letters
        that the languages write there, each as often as it is written. Then every symbol gets one letter of its own, the
        surest first. Believed only with enough different occurrences inside words, of several symbols, placed as their letters are.
        """
        rows = [x for x in seen if len(x[0]) == 1 and x[0] not in self.attested and x[0] not in MARKS and x[0].isprintable()]
        inside = [x for x in rows if x[1] in _WORDLY or x[2] in _WORDLY]
        within = sum(x[1] in _WORDLY and x[2] in _WORDLY for x in inside)
        if len({x[0] for x in inside}) < LEARNED_KINDS or len(inside) < LEARNED_SPOTS or len(inside) < 0.8 * len(rows) or within < 0.5 * len(inside):
            return {}
        letters = [c for c in LANGUAGE if c in self.attested and c not in MARKS]
        symbols = sorted({x[0] for x in inside})
        if not letters:
            return {}
        at = np.array([symbols.index(x[0]) for x in inside])
        model = self.joint[[_AT[c] for c in letters]]
        fit = np.array([model[:, x[1], x[2]] for x in inside])  # how well each letter stands between the neighbours
        often = np.array([self.often[c] for c in letters])
        often /= often.sum()
        q = np.tile(often, (len(symbols), 1))
        for _ in range(rounds):
            post = q[at] * fit
            post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
            q = 0.5 * often
            q = np.stack([q + post[at == k].sum(0) for k in range(len(symbols))])
            q /= q.sum(1, keepdims=True)
        told = np.log(np.maximum(fit, 1e-12)) - np.log(np.array([self.plain[x[1], x[2]] for x in inside]))[:, None]
        gain = np.stack([told[at == k].sum(0) for k in range(len(symbols))])
        counts = np.bincount(at, minlength=len(symbols))
        sure = np.where(q >= 0.02, gain + counts[:, None] * np.log(often)[None, :], -np.inf)
        out: dict[str, str] = {}
        total = 0.0
        for k in np.argsort(-counts, kind="stable"):  # the commonest symbol chooses first
            j = int(sure[k].argmax())
            if np.isfinite(sure[k, j]) and gain[k, j] > 0:
                out[symbols[k]] = letters[j]
                total += gain[k, j]
                sure[:, j] = -np.inf
        spots = sum(x[0] in out for x in inside)
        main = letters[int(often.argmax())]
        mix = sum(x[3] for x in inside if out.get(x[0]) == main) / max(1, sum(x[3] for x in inside))
        return out if total >= LEARNED_TOLD and len(out) >= LEARNED_KINDS and spots >= 0.8 * len(inside) and mix >= 0.2 * often.max() else {}

    def _told(self, symbols: list[str], r: np.ndarray, post: np.ndarray, j: int) -> bool:
        """Whether a source's symbols tell of a swap by themselves: letters, of several kinds, in the mix that languages write.
        A symbol between the same neighbours counts once, as names that come again are no further evidence."""
        cipher = CIPHERS[NAMES[j]]
        got: dict[str, float] = {}
        told = 0.0
        for g, x, p in zip(symbols, r, post):
            c = cipher.get(g)
            if c and p >= 0.5 and c not in MARKS:
                got[c] = got.get(c, 0.0) + p
                told += np.log(x)
        meant = {c: self.often[c] for c in cipher.values() if c not in MARKS}
        main = max(meant, key=meant.get)
        return told >= TOLD and len(got) >= KINDS and sum(got.values()) >= SYMBOLS and got.get(main, 0.0) / sum(got.values()) >= 0.2 * meant[main] / sum(meant.values())

    def _own(self, g: str, left: int, right: int) -> float:
        return self.joint[_AT[g], left, right] if g in _AT else self.plain[left, right]

    def _swapped(self, g: str, left: int, right: int) -> list[float]:
        return [self.often[c] * self.joint[_AT[c], left, right] if (c := CIPHERS[name].get(g)) and c in self.attested else 0.0 for name in NAMES]

    def ratios(self, g: str, left: int, right: int) -> np.ndarray:
        """For each swap: how much better it explains the occurrence than the symbol itself does."""
        return np.array(self._swapped(g, left, right)) / (self.itself.get(g, 1e-7) * self._own(g, left, right))

    def evidence(self, g: str, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each active swap: ln of its ratio, whether it explains the symbol at all, whether what it tells is only a mark."""
        at = self.active_at
        r = self.ratios(g, left, right)[at]
        inside = r >= 0.2
        mark = self.marks[g][at] & (r < np.exp(9)) if g in self.marks else np.zeros(len(at), bool)
        return np.log(np.where(inside, r, 1.0)), inside, mark

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_known", "_rows", "_common", "_ratios")}

    def also(self, swaps: list[int]) -> None:
        """Those swaps, used in some source, are looked for too."""
        self.active_at = np.union1d(self.active_at, np.array(swaps, int)).astype(int)
        self.active = [NAMES[i] for i in self.active_at]

    def doubtful(self) -> set[str]:
        return set().union(*(CIPHERS[name] for name in self.active)) if self.active else set()


def source_counts(rows: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """``source, g, l, r, n, listed``: occurrences of symbol and neighbours over all texts of all fields of a source. Symbols are those
    some swap makes, and the letters (listed: a fixed set), and all of one character."""

    def count(batches):
        held: dict[str, Counter] = {}
        size = 0

        def flush():
            out: dict = {}
            for own_source, own in held.items():
                for (a, g, b), n in own.items():
                    if g in _COUNTED or (len(g) == 1 and g != LOST):
                        at = (own_source, g, _CLASS[a], _CLASS[b])
                        out[at] = out.get(at, 0) + n
            listed = [a[1] in _COUNTED for a in out]
            return pa.RecordBatch.from_arrays(
                [pa.array([a[0] for a in out], pa.string()), pa.array([a[1] for a in out], pa.string()), pa.array([a[2] for a in out], pa.int32()), pa.array([a[3] for a in out], pa.int32()), pa.array(list(out.values()), pa.int64()), pa.array(listed, pa.bool_())],
                names=["source", "g", "l", "r", "n", "listed"],
            )

        for batch in batches:
            for own_source, *texts in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                own = held.setdefault(own_source, Counter())
                for got in _raws(texts):
                    size -= len(own)
                    own.update(got)
                    size += len(own)
            if size > 500_000:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    named = rows.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    return named.mapInArrow(count, "source string, g string, l int, r int, n long, listed boolean").groupBy("source", "g", "l", "r").agg(F.sum("n").alias("n"), F.first("listed").alias("listed"))


def symbol_counts(per_source: DataFrame) -> dict[tuple[str, int, int], int]:
    """(symbol, left, right) -> occurrences over all sources, of the fixed set of symbols."""
    return {(r.g, r.l, r.r): r.n for r in per_source.where("listed").groupBy("g", "l", "r").agg(F.sum("n").alias("n")).collect()}


class Judge:
    """What each active swap gains over a field's symbols, many fields at a time.

    What only marks tell (dashes, bullets, quotes) counts where letters tell the same, or where the symbol is not written at all.
    Only a stretch may be garbled: symbols that a swap explains badly count as standing outside it, at the price ``partly``. The same
    symbol between the same neighbours counts ``most`` times at most.
    """

    def __init__(self, model: Model, odd: set[str], learned: set[str], partly: float = 0.7, most: int = 3, held: int = 400_000) -> None:
        self.model, self.odd, self.learned, self.partly, self.most, self.held = model, odd, learned, partly, most, held
        self.place: dict = {}
        self.known: tuple[list, list, list] = ([], [], [])
        self.tables: tuple | None = None

    def items(self, raw: Counter) -> tuple[list[tuple], bool, list[tuple]]:
        """(doubtful symbols with class of neighbours and number, whether characters are lost, symbols that were learned somewhere)."""
        own: dict = {}
        new: dict = {}
        lost = False
        for (a, g, b), n in raw.items():
            if g in self.odd:
                s = (g, _CLASS[a], _CLASS[b])
                own[s] = own.get(s, 0) + n
            elif g in self.learned:
                s = (g, _CLASS[a], _CLASS[b])
                new[s] = new.get(s, 0) + n
            elif LOST in g:
                lost = True
        return list(own.items()), lost, [(*s, n) for s, n in new.items()]

    def gains(self, fields: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
        """(gain, price of what stands outside) of fields (rows, none of them empty) and active swaps."""
        if len(self.place) > self.held:
            self.place, self.known, self.tables = {}, ([], [], []), None
        at = []
        for own in fields:
            for s, _ in own:
                i = self.place.get(s)
                if i is None:
                    i = self.place[s] = len(self.place)
                    for column, value in zip(self.known, self.model.evidence(*s)):
                        column.append(value)
                    self.tables = None
                at.append(i)
        if self.tables is None:
            self.tables = tuple(np.array(c) for c in self.known)
        told, inside, mark = (t[at] for t in self.tables)
        begin = np.cumsum([0] + [len(own) for own in fields[:-1]])
        told = told * np.minimum([n for own in fields for _, n in own], self.most)[:, None]
        marks = np.add.reduceat(np.where(mark, told, 0.0), begin, axis=0)
        gain = np.add.reduceat(np.where(mark, 0.0, told), begin, axis=0)
        outside = np.logical_or.reduceat(~inside, begin, axis=0)
        return gain + np.where(gain >= 3.0, marks, 0.0), self.partly * outside


def _judged(rows: DataFrame, key: str, source: str, fields: list[str], sure: float, weight: float) -> tuple[DataFrame, object]:
    """(``key, field, chance, swap, learned``, the broadcast model)."""
    spark = rows.sparkSession
    per = written(source_counts(rows, source, fields), "sources")
    model = Model(symbol_counts(per))
    first = spark.sparkContext.broadcast(model)

    def refine(batches):
        """The sources of a partition; a source's rows are at most symbols x neighbours, whatever its size."""
        m = first.value
        held: dict[str, list] = {}
        single: dict[str, list] = {}
        for batch in batches:
            for s, g, left, right, n, listed in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if listed:
                    held.setdefault(s, []).append((g, left, right, n))
                if len(g) == 1 and g not in m.attested:
                    single.setdefault(s, []).append((g, left, right, n))
        out = []
        common = m.doubtful()
        for s in held.keys() | single.keys():
            share = m.source_share(held.get(s, []), weight)
            told = common.union(*(CIPHERS[NAMES[j]] for j in np.flatnonzero(share[1:] > 0))) if share is not None else common
            unlisted = [x for x in single.get(s, []) if x[0] not in told]
            own = m.learned(unlisted) if len(unlisted) >= LEARNED_SPOTS else {}
            if share is not None or own:
                out.append((s, None if share is None else share.tolist(), list(own.items())))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.map_(pa.string(), pa.string()))], names=["source", "share", "learned"])

    shares = written(per.repartition("source").mapInArrow(refine, "source string, share array<double>, learned map<string,string>"), "shares")
    used = shares.select(F.posexplode("share").alias("i", "v")).where("i > 0 and v > 0").select("i").distinct().collect()
    model.also([r.i - 1 for r in used])
    new = {r[0] for r in shares.select(F.explode(F.map_keys("learned"))).distinct().collect()}
    shared = spark.sparkContext.broadcast((model, model.doubtful(), new))
    kind = dict(rows.dtypes)[key]

    def find(batches):
        judge = Judge(*shared.value)
        active = judge.model.active_at
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                row, field, lost, own, other = [], [], [], [], []
                for i, texts in enumerate(zip(*(part.column(2 + k).to_pylist() for k in range(len(fields))))):
                    for name, raw in zip(fields, _raws(list(texts))):
                        if raw:
                            items, gone, unlisted = judge.items(raw)
                            if items or gone or unlisted:
                                row.append(i)
                                field.append(name)
                                lost.append(gone)
                                own.append(items)
                                other.append(unlisted)
                some = [k for k, x in enumerate(own) if x] if len(active) else []
                told: list[list] = [[] for _ in row]
                if some:
                    gain, price = judge.gains([own[k] for k in some])
                    at, j = np.nonzero(gain >= 2.0)
                    for k, a, v in zip(at.tolist(), active[j].tolist(), (gain - price)[at, j].tolist()):
                        told[some[k]].append({"swap": a, "gain": v})
                keep = [k for k in range(len(row)) if told[k] or lost[k] or other[k]]
                at = pa.array([row[k] for k in keep], pa.int64())
                new = [[{"g": g, "l": a, "r": b, "n": n} for g, a, b, n in other[k]] for k in keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array([field[k] for k in keep], pa.string()), pa.array([lost[k] for k in keep], pa.bool_()), pa.array([told[k] for k in keep], _TOLD_KIND), pa.array(new, _SEEN_KIND)],
                    names=["key", "source", "field", "lost", "told", "seen"],
                )

    plain = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), *fields)
    schema = f"key {kind}, source string, field string, lost boolean, told array<struct<swap:int,gain:double>>, seen array<struct<g:string,l:int,r:int,n:int>>"
    found = written(plain.mapInArrow(find, schema), "doubtful")

    def decide(batches):
        m = shared.value[0]
        for batch in batches:
            chance, swap = [], []
            for lost, told, seen, share, learned in zip(*(batch.column(k).to_pylist() for k in range(2, 7))):
                share = m.share if share is None else share
                score = [(np.log(share[1 + t["swap"]]) + t["gain"], t["swap"]) for t in told if share[1 + t["swap"]] > 0]
                w = sum(np.exp(min(x, 600.0)) for x, _ in score)
                c, name = (w / (w + share[0]), NAMES[max(score)[1]]) if score else (0.0, "")
                if learned and c < sure:
                    own = dict(learned)
                    gain = sum(min(x["n"], 3) * np.log(m.joint[_AT[own[x["g"]]], x["l"], x["r"]] / m.plain[x["l"], x["r"]]) for x in seen if x["g"] in own)
                    if gain >= 2.0:
                        c, name = float(1 / (1 + np.exp(-gain))), LEARNED
                swap.append(name if c >= sure else "lost" if lost else "")
                chance.append(1.0 if lost else float(c))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chance, pa.float64()), pa.array(swap, pa.string()), batch.column(6)], names=["key", "field", "chance", "swap", "learned"])

    judged = join_facts(found, shares, "source", "key").select("key", "field", "lost", "told", "seen", "share", "learned").mapInArrow(decide, f"key {kind}, field string, chance double, swap string, learned map<string,string>")
    best = judged.where(F.col("chance") >= sure).groupBy("key", "field").agg(F.max_by(F.struct("chance", "swap", "learned"), "chance").alias("j"))
    return best.select("key", "field", "j.chance", "j.swap", "j.learned"), shared


_TOLD_KIND = pa.list_(pa.struct([("swap", pa.int32()), ("gain", pa.float64())]))
_SEEN_KIND = pa.list_(pa.struct([("g", pa.string()), ("l", pa.int32()), ("r", pa.int32()), ("n", pa.int32())]))


def garbled_fields(rows: DataFrame, key: str, source: str, fields: list[str], sure: float = 0.5, weight: float = 50.0) -> DataFrame:
    """``key, field, chance, swap``: the fields with text garbled by wrong decoding, how sure that is, and by which swap.

    Null texts and keys are left out, as are texts of ASCII only; rows with a null source share one. A field with replacement
    characters is garbled (swap "lost" if no other). swap is "learned" where the source's page is not in the list. Repeated rows of a
    key count once (the surest). An empty table gives no rows. Other columns are ignored. weight: occurrences that the common
    shares count for in a source.
    """
    return _judged(rows, key, source, fields, sure, weight)[0].select(F.col("key").alias(key), "field", "chance", "swap")


_TABLES: dict[str, dict] = {}


def _table(swap: str) -> dict:
    """For single-byte swaps: the translate() table from symbol to letter."""
    if swap not in _TABLES:
        _, true, wrong = next(s for s in _swaps() if s[0] == swap)
        out: dict = {}
        for b in range(128, 256):
            letter = _bytes_to_text(bytes([b]), true)
            out.setdefault(_bytes_to_text(bytes([b]), wrong), letter)
        _TABLES[swap] = str.maketrans({k: v for k, v in out.items() if len(k) == 1})
    return _TABLES[swap]


def _undone(run: str, swap: str) -> str:
    """The run with the swap undone where that is certain: the swap, done again, gives the run back."""
    name, true, wrong = next(s for s in _swaps() if swap == s[0] or swap.startswith(s[0] + ">"))
    if true != WIDE:
        back = run.translate(_table(name))
        return back if garble(back, true, wrong) == run else run
    if swap.endswith(">dropped"):
        return CIPHERS[swap].get(run, run)
    for _ in range(2 if swap.endswith(">again") else 1):
        raw = bytearray()
        for ch in run:
            try:
                raw += ch.encode(wrong)
            except UnicodeEncodeError:
                if ord(ch) > 255:
                    return run
                raw.append(ord(ch))
        try:
            run = raw.decode(WIDE)
        except UnicodeDecodeError:
            return run
    return run


def restored(text: str | None, swap: str, model: Model | None = None, learned: dict[str, str] | None = None) -> str | None:
    """The text with the swap undone in every symbol that it explains better than the symbol itself."""
    if not text or swap in ("", "lost"):
        return text
    if swap == LEARNED:
        return text.translate(str.maketrans(learned or {}))
    k = NAMES.index(swap)

    def one(m: re.Match) -> str:
        g = m.group()
        if model is not None and g in model.itself and swap.split(">")[0] != WIDE:
            a, b = m.span()
            if model.ratios(g, _context(text[a - 1] if a else ""), _context(text[b] if b < len(text) else ""))[k] < 1:
                return g
        return _undone(g, swap)

    return _RUN.sub(one, text)


def _passage(text: str) -> re.Pattern | None:
    """What the text's plain parts look like in another rendering: anything beyond ASCII (or a question mark) may stand between them."""
    plain = "".join(x if x.isascii() and x != "?" else "\0" for x in text)
    parts = re.split("\0+", plain)
    if len(parts) > 2000 or len(text) < 8:
        return None
    return re.compile(r"[^\x00-\x3e\x40-\x7f]*".join(map(re.escape, parts)))


def from_sibling(text: str, fixed: str, sibling: str | None) -> str:
    """The restored text, with the passage that a sound sibling field also holds taken from there: the whole text if the sibling
    contains it, or its end if that is the sibling."""
    if not sibling or not text:
        return fixed
    whole = _passage(text)
    if whole is not None and (m := whole.search(sibling)):
        return m.group()
    tail = _passage(sibling)
    if tail is not None:
        m = re.search(f"(?:{tail.pattern})\\Z", text)
        again = re.search(f"(?:{tail.pattern})\\Z", fixed) if m else None
        if again:
            return fixed[: again.start()] + sibling
    return fixed


def restored_fields(rows: DataFrame, key: str, source: str, fields: list[str], sure: float = 0.5, weight: float = 50.0) -> DataFrame:
    """``key, field, swap, chance, text``: the garbled fields with their text restored as far as it is still known.

    Where another of the fields is sound and holds the same passage, lost characters come from there. Repeated rows of one key
    give one row for each field (the greatest text in string order, should they differ).
    """
    judged, shared = _judged(rows, key, source, fields, sure, weight)
    one = rows.where(F.col(key).isNotNull()).join(judged.select(F.col("key").alias(key)).distinct(), key, "left_semi").groupBy(F.col(key).alias("key")).agg(*[F.max(f).alias(f"f{i}") for i, f in enumerate(fields)])
    facts = judged.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("swap", "chance", "learned")))).alias("facts"))
    kind = dict(rows.dtypes)[key]

    def undo(batches):
        m = shared.value[0]
        for batch in batches:
            row, out = [], []
            for i, (facts, *texts) in enumerate(zip(*(batch.column(1 + k).to_pylist() for k in range(1 + len(fields))))):
                bad = dict(facts)
                sound = [t for f, t in zip(fields, texts) if f not in bad and t]
                for f, t in zip(fields, texts):
                    if f in bad and t is not None:
                        x = bad[f]
                        fixed = restored(t, x["swap"], m, dict(x["learned"] or ()))
                        for other in sound:
                            fixed = from_sibling(t, fixed, other)
                        row.append(i)
                        out.append((f, x["swap"], x["chance"], fixed))
            kinds = (pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array([o[k] for o in out], kinds[k]) for k in range(4)]], names=["key", "field", "swap", "chance", "text"])

    both = facts.join(one, "key").select("key", "facts", *[f"f{i}" for i in range(len(fields))])
    return both.mapInArrow(undo, f"key {kind}, field string, swap string, chance double, text string").withColumnRenamed("key", key)


def _p1_rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/chunks.parquet").select("chunk_id", "source_file", "content", "indexed_content")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of chunks that hold garbled text."""
    return garbled_fields(_p1_rows(spark, folder), "chunk_id", "source_file", ["content", "indexed_content"]).select("chunk_id", F.col("field").alias("field_name"))


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled fields with their restored text."""
    return restored_fields(_p1_rows(spark, folder), "chunk_id", "source_file", ["content", "indexed_content"]).withColumnRenamed("field", "field_name")


QUERIES = {"p1_found": p1_found, "p1_restored": p1_restored}
SQL: dict[str, str] = {}
