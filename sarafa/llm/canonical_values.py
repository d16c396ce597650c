"""Typed values mapped to the entries of a reference list, or reported as unmatched.

A multi-pattern automaton over the list's canonical names and their aliases finds every name embedded in a value;
of overlapping finds the longest wins, from left to right, and a value whose finds all mean one entry and leave
only filler words is settled. What remains goes to token-set similarity: each word of the value is matched to words
of the entries (equal, a beginning of at least three letters, a contraction, or one slip of the pen), and the
value means the entry that alone explains all its words best. A value that no entry explains as a whole means the one
entry whose name stands in it ("bought ABCDEF on dip"). Anything else is UNMATCHED.

Similar words are looked up, never compared with the whole list: words that can stand for each other share their first
three letters or what is left of them without one letter.

The reference lists are small dimensions (hundreds of names). Their size is checked before they are
broadcast; each task remembers the distinct values it has seen, within a bound, so there is no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "UNMATCHED"
#: Entries a list may have to be shipped to every task.
MAX_ENTRIES = 100_000
#: Letters a name must have to count inside a longer text: shorter ones are words of the language too.
MENTION = 4
#: Values a task remembers before it starts afresh.
REMEMBERED = 200_000

# ---- fixed values ----
#: Words that name no entry by themselves.
FILLERS = frozenset("the ltd limited co cos company companies corp inc plc sector sectors industry industries group and of in eq be n b bse nse ns bo s".split())
EXCHANGES = re.compile(r"^(?:nse|bse)\s*:\s*|(?:\.ns|\.bo|[\s-]eq|\s*\([a-z]\))$")
#: Words that are passed over where an entry does not have them, if another word of the value is found.
SOFT = frozenset("services svcs svc business businesses others other misc general".split())
#: Usual short forms that are no beginning of the word they stand for.
SHORT_FORMS = {"svcs": "services", "svc": "services", "eqpt": "equipment", "eqp": "equipment", "mfg": "manufacturing", "defense": "defence", "mgmt": "management", "pvt": "private", "intl": "international", "tech": "technology", "info": "information", "ent": "entertainment"}
# ---- end of fixed values ----


def fold(value: str) -> str:
    """Lower case without accents, invisible characters and outer space; every kind of inner space is a blank."""
    s = "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) not in ("Cf", "Mn"))
    return " ".join(s.lower().split())


def words_of(folded: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded.replace("&", " and "))


def slips(a: str, b: str, most: int = 1) -> int:
    """Edit distance with swaps of neighbours, or most + 1 when it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, last = last, now
    return min(last[-1], most + 1)


def _without_one(word: str) -> set[str]:
    """The word, and all that remains of it without one letter."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def _parts_of(word: str) -> set[str]:
    """What two words share at least one of if either can stand for the other."""
    bare = word.rstrip("s")
    gaps = {f"~{v}" for w in (word, bare) for v in _without_one(w)}
    return {word, word[:3], *gaps}


def alike(typed: str, word: str) -> float:
    """How well a typed word stands for a word of an entry: 1 equal, 0 not at all."""
    if typed == word or SHORT_FORMS.get(typed) == word:
        return 1.0
    if typed.isdigit() or word.isdigit():
        return 0.0
    if len(typed) >= 3 and word.startswith(typed):
        return 0.9
    if len(typed) >= 4 and len(word) >= 4 and min(slips(typed, word), slips(typed.rstrip("s"), word.rstrip("s"))) <= 1:
        return 0.85
    for a, b in ((typed, word), (typed.rstrip("s"), word.rstrip("s"))):
        if len(a) >= 4 and len(b) >= 4 and _stem(a) == _stem(b):
            return 0.8
    if len(typed) >= 4 and len(word) >= len(typed) - 1:
        # A beginning with one slip, or one with an ending of its own (financials, automobile co).
        if typed[:-1] and word.startswith(typed[:-1]) and len(typed) >= 5:
            return 0.75
    return 0.0


def _stem(w: str) -> str:
    for end in ("ies", "es", "s", "y", "ity", "ing"):
        if w.endswith(end) and len(w) - len(end) >= 4:
            return w[: -len(end)]
    return w


class Matcher:
    """Values to entries of one list: entries maps a canonical name to its aliases."""

    def __init__(self, entries: dict[str, list[str]], closed_up: bool = False) -> None:
        """closed_up: whether names are codes in one word, in which blanks and signs may have slipped."""
        self.closed_up = closed_up
        self.exact = set(entries)
        self.by_name: dict[str, set[str]] = defaultdict(set)
        self.entry_words: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for name, aliases in entries.items():
            for alias in (name, *aliases):
                text = " ".join(words_of(fold(alias)))
                if not text:
                    continue
                self.by_name[text].add(name)
                kept = tuple(w for w in text.split() if w not in FILLERS)
                if kept:
                    self.by_name[" ".join(kept)].add(name)
                    self.entry_words[name].append(kept)
                    self.by_name["".join(kept)].add(name)
                    acronym = "".join(w[0] for w in kept)
                    if len(kept) > 1 and not closed_up:
                        self.by_name[acronym].add(name)
        # Words of the entries by what a word that stands for them shares with them, and the forms they occur in.
        self.by_part: dict[str, set[str]] = defaultdict(set)
        self.forms_with: dict[str, set[tuple[str, tuple[str, ...]]]] = defaultdict(set)
        for name, forms in self.entry_words.items():
            for form in forms:
                for w in form:
                    self.forms_with[w].add((name, form))
        for w in self.forms_with:
            for part in _parts_of(w):
                self.by_part[part].add(w)
        self.near: dict[str, dict[str, float]] = {}
        self.spoken = {" ".join(words_of(fold(a))) for name, aliases in entries.items() for a in (name, *aliases)}
        self.spoken |= {" ".join(form) for forms in self.entry_words.values() for form in forms}
        self.automaton = ahocorasick.Automaton()
        for text in self.by_name:
            self.automaton.add_word(f" {text} ", text)
        if self.by_name:
            self.automaton.make_automaton()
        self.longest = max(map(len, self.by_name), default=0)
        # Two words one slip apart agree after at most one letter is left out of each.
        self.less_one: dict[str, set[str]] = defaultdict(set)
        for t, n in self.by_name.items():
            if len(n) == 1 and " " not in t and len(t) >= 4 and not t.isdigit():
                for v in _without_one(t):
                    self.less_one[v].add(t)

    def match(self, value: str) -> str:
        """The entry a non-blank value means, or UNMATCHED."""
        if value in self.exact:
            return value
        folded = fold(value)
        stripped = folded
        while (shorter := EXCHANGES.sub("", stripped).strip()) != stripped and shorter:
            stripped = shorter
        words = words_of(stripped)
        if not words:
            return UNMATCHED
        taken = self._finds(words)
        return self._embedded(words, taken) or self._joined(words) or self._similar(words) or self._mentioned(words, taken) or UNMATCHED

    def _finds(self, words: list[str]) -> list[tuple[int, int, str]]:
        """Longest non-overlapping finds of the automaton: (start, end, name)."""
        if not self.by_name:
            return []
        text = f" {' '.join(words)} "
        finds = sorted(((end - len(t) - 1, end, t) for end, t in self.automaton.iter(text)), key=lambda f: (-(f[1] - f[0]), f[0]))
        taken: list[tuple[int, int, str]] = []
        for a, b, t in finds:
            # The blanks around a name may be shared by two names.
            if all(b - 1 <= x or a >= y - 1 for x, y, _ in taken):
                taken.append((a, b, t))
        return taken

    def _mentioned(self, words: list[str], taken: list[tuple[int, int, str]]) -> str | None:
        """The one entry that is named in full inside a longer text.

        A single word that opens the value and is followed by others may be part of another name ("Abcdef Finance"), and so may a
        name beside words of other entries; these do not count.
        """
        named = [(a, t) for a, _, t in taken if len(t) >= MENTION and t in self.spoken and not t.isdigit()]
        one = set.intersection(*(self.by_name[t] for _, t in named)) if named else set()
        inside = {w for _, t in named for w in t.split()}
        if len(one) != 1 or any(w in self.forms_with for w in words if w not in inside):
            return None
        return next(iter(one)) if any(a > 0 or " " in t for a, t in named) else None

    def _embedded(self, words: list[str], taken: list[tuple[int, int, str]]) -> str | None:
        """The finds settle the value if they mean one entry and leave fillers only."""
        if not taken:
            return None
        text = f" {' '.join(words)} "
        covered = {i for a, b, _ in taken for i in range(a, b + 1)}
        rest = words_of("".join(" " if i in covered else c for i, c in enumerate(text)))
        meant = set.intersection(*(self.by_name[t] for *_, t in taken))
        if len(meant) == 1 and all(w in FILLERS for w in rest):
            return next(iter(meant))
        return None

    def _joined(self, words: list[str]) -> str | None:
        """Names with slipped blanks or signs, and names with one slip of the pen, among the one-word forms."""
        kept = [w for w in words if w not in FILLERS] or words
        for text in dict.fromkeys(("".join(kept), "".join(words))):
            meant = self.by_name.get(text, set())
            if len(meant) == 1:
                return next(iter(meant))
        text = "".join(kept)
        if len(text) < 5 or text.isdigit():
            return None
        close = set().union(*(self.less_one.get(v, ()) for v in _without_one(text))) if len(text) <= self.longest + 1 else set()
        near = {next(iter(self.by_name[t])) for t in close if slips(text, t) <= 1}
        return next(iter(near)) if len(near) == 1 else None

    def _similar(self, words: list[str]) -> str | None:
        """Token-set similarity: all typed words must stand for words of the entry; the best entry must be alone.

        Where the first word of a list of codes names the company, the other words must agree as well.
        """
        kept = [w for w in words if w not in FILLERS]
        if not kept:
            return None
        if len(kept) > 1 and len("".join(kept)) <= 6 and not self.closed_up and (meant := self.by_name.get("".join(kept), set())):
            return next(iter(meant)) if len(meant) == 1 else None
        scored: dict[str, float] = {}
        near = [self._near(w) for w in kept]
        # Words that must be explained; the one with the fewest likenesses names the forms to look at.
        firm = [n for w, n in zip(kept, near) if self.closed_up or w not in SOFT]
        words = min(firm, key=len) if firm else set().union(*near)
        for name, form in {f for w in words for f in self.forms_with[w]}:
            score = self._score(kept, near, form)
            if score > scored.get(name, 0.0):
                scored[name] = score
        if not scored:
            return None
        # A value that other entries explain as fully by their words means none of them alone.
        best = max(scored.values())
        near = [n for n, s in scored.items() if s > best * (0.8 if len(kept) == 1 and best < 0.9 else 1 - 1e-9)]
        return near[0] if len(near) == 1 else None

    def _near(self, typed: str) -> dict[str, float]:
        """The words of the entries that a typed word may stand for, with how well it does."""
        if typed not in self.near:
            if len(self.near) >= REMEMBERED:
                self.near.clear()
            could = set().union(*(self.by_part.get(p, ()) for p in {*_parts_of(typed), *_parts_of(SHORT_FORMS.get(typed, typed))}))
            self.near[typed] = {w: x for w in could if (x := alike(typed, w))}
        return self.near[typed]

    def _score(self, typed: list[str], near: list[dict[str, float]], form: tuple[str, ...]) -> float:
        """Mean likeness of the typed words times the part of the entry they explain; 0 if one explains nothing."""
        left, total, counted = list(form), 0.0, 0
        for w, likeness in zip(typed, near):
            best = max(((likeness.get(x, 0.0), -i) for i, x in enumerate(left)), default=(0.0, 0))
            if best[0] == 0.0:
                if w in SOFT and not self.closed_up:
                    continue
                return 0.0
            total += best[0]
            counted += 1
            left.pop(-best[1])
        if not counted or (self.closed_up and left):
            return 0.0
        return total / len(typed) * (1 - len(left) / (2 * len(form)))


def _column(values: list[str | None], matcher: Matcher, known: dict[str, str]) -> list[str | None]:
    """None for blank values and for values that are entries already."""
    out = []
    for v in values:
        if v is None or not v.strip() or v in matcher.exact:
            out.append(None)
            continue
        if v not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known[v] = matcher.match(v)
        out.append(known[v])
    return out


def read_list(df: DataFrame, name: str, aliases: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """A reference list as {entry: aliases}; raises when it is too large to be shipped. Null entries are left out."""
    rows = df.select(F.col(name).cast("string"), *(F.col(a).cast("string").alias(f"alias_{i}") for i, a in enumerate(aliases))).filter(F.col(name).isNotNull()).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the list has more than {MAX_ENTRIES} entries; join it in parts")
    out: dict[str, list[str]] = defaultdict(list)
    for r in rows:
        out[r[0]] += [x for x in r[1:] if x]
    return dict(out)


def canonical_values(holdings: DataFrame, symbols: DataFrame, sectors: DataFrame) -> DataFrame:
    """(holding_id, field, canonical): one row for each non-blank symbol or sector that is no entry as it stands.

    Null and blank values give no row; repeated rows each give theirs; empty lists leave every value UNMATCHED;
    an empty table gives an empty result; further columns are ignored.
    """
    lists = holdings.sparkSession.sparkContext.broadcast((read_list(symbols, "symbol", ("company_name", "scrip_code")), read_list(sectors, "sector")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = None
        for batch in batches:
            tools = tools or [(f, Matcher(lists.value[i], closed), {}) for i, (f, closed) in enumerate((("symbol", True), ("sector", False)))]
            ids = batch.column(0).to_pylist()
            rows = [(i, f, c) for k, (f, m, known) in enumerate(tools) for i, c in zip(ids, _column(batch.column(k + 1).to_pylist(), m, known)) if c is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((batch.schema.field(0).type, pa.string(), pa.string()))], names=["holding_id", "field", "canonical"])

    kind = holdings.schema["holding_id"].dataType.simpleString()
    return holdings.select("holding_id", F.col("symbol").cast("string"), F.col("sector").cast("string")).mapInArrow(run, f"holding_id {kind}, field string, canonical string")
