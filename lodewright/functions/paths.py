"""Example paths, close names, upload names and text edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder names that mark examples, best first.
EXAMPLES = [
    "scripts", "examples", "example", "notebooks", "notebook", "tutorials", "tutorial", "quickstart", "walkthroughs", "walkthrough", "cookbook", "cookbooks", "recipes", "recipe",
    "demos", "demo", "samples", "sample", "guides", "guide", "getting-started", "getting_started", "playground", "howto", "how-to", "use-cases", "usecases", "use_cases", "sandbox", "showcase",
]
# File-name words that say nothing.
DULL = ["data", "dataset", "file", "files", "note", "notes", "pair", "pairs", "reference", "references", "upload", "uploads"]
# Characters that an edit may spell plainly.
PLAIN = {
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u00a0": " ", "\u2003": " ", "\u2002": " ", "\u200b": "", "\ufeff": "",
}


def path_priority(path: Column) -> Column:
    """(outside, pattern, depth), lower is better: 0 below a top folder of examples, the place of the deepest marking folder in
    ``EXAMPLES`` (999: none), and the number of parts."""
    parts = F.split(F.lower(path), "/")
    marks = F.lit(EXAMPLES)
    deepest = F.try_element_at(F.filter(parts, lambda p: F.array_contains(marks, p)), F.lit(-1))
    return F.struct(
        F.when(parts[0].isin("examples", "example"), 0).otherwise(1).cast("long").alias("outside"),
        F.coalesce(F.array_position(marks, deepest) - 1, F.lit(999)).cast("long").alias("pattern"), F.size(parts).cast("long").alias("depth"),
    )


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step a character."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for ch in b:
        hit = open_ & where.get(ch, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def _ratio(a: str, b: str) -> float:
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _words(s: str) -> set[str]:
    return set("".join(ch if ch.isalnum() else " " for ch in s.lower()).split())


def _set_ratio(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    left, right = (f"{both} {' '.join(sorted(d))}".strip() for d in (x - y, y - x))
    return max([_ratio(left, right)] + ([_ratio(both, left), _ratio(both, right)] if both else []))


def _part_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows cut at its ends included."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    return max(_ratio(a, b[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(b)))


def example_score(path: Column) -> Column:
    """0 to 100: the best word-set ratio of a path with a marking folder name; null for null."""

    @F.pandas_udf("int")
    def best(paths: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else round(max(_set_ratio(e, p) for e in EXAMPLES)) for p in paths], dtype="Int32")

    return best(path)


def keyword_score(path: Column, keyword: str) -> Column:
    """0 to 100: the better of the window ratio and the word-set ratio; null for null."""
    word = keyword.lower()

    @F.pandas_udf("int")
    def best(paths: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else round(max(_part_ratio(word, p.lower()), _set_ratio(word, p))) for p in paths], dtype="Int32")

    return best(path)


def close_names(name: Column, known: list[str], n: int = 3) -> Column:
    """Up to ``n`` of the known names at a similarity of 0.4 or more, closest first; what follows a colon is not compared."""

    @F.pandas_udf("array<string>")
    def close(names: pd.Series) -> pd.Series:
        from difflib import get_close_matches

        return pd.Series([None if s is None else get_close_matches(s.split(":", 1)[0], known, n, 0.4) for s in names], dtype=object)

    return close(name)


def repo_name(repo: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(repo), "^datasets/", ""), "^/+|/+$", "")


def owned_repo(repo: Column, owner: Column, app_user: Column, placeholders: tuple[str, ...] = ("dev",)) -> Column:
    """The repository under its owner's name where its namespace is missing or one of ``placeholders``; as it is without an owner."""
    bare = repo_name(repo)
    space, rest = F.substring_index(bare, "/", 1), F.regexp_extract(bare, "^[^/]*/(.*)$", 1)
    move = space.isin(*placeholders) | F.coalesce(space == app_user, F.lit(False))
    named = F.coalesce(F.length(owner) > 0, F.lit(False)) & (bare != "")
    return F.when(named & ~bare.contains("/"), F.concat_ws("/", owner, bare)).when(named & move, F.concat_ws("/", owner, rest)).otherwise(bare)


def file_slug(names: Column) -> Column:
    """Words of one file name and its extension, or the first telling word of each of the first four and ``bundle``; empty for none."""

    def pieces(name: Column) -> Column:
        base = F.element_at(F.split(F.regexp_replace(F.trim(name), r"[/\\]+$", ""), r"[/\\]"), -1)
        ending = F.regexp_extract(base, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)
        stem = F.substr(base, F.lit(1), F.length(base) - F.length(ending))
        return F.struct(F.regexp_extract_all(F.lower(stem), F.lit("([a-z0-9]+)"), F.lit(1)).alias("words"), F.ltrim(F.lower(ending), F.lit(".")).alias("ending"))

    files = F.filter(F.transform(F.filter(names, lambda x: F.length(x) > 0), pieces), lambda f: (F.size(f["words"]) > 0) | (f["ending"] != ""))
    words = lambda f: F.when(F.size(f["words"]) > 0, f["words"]).otherwise(F.array(F.lit("dataset")))
    telling = lambda f: F.coalesce(F.get(F.filter(words(f), lambda w: ~w.isin(DULL)), F.lit(0)), words(f)[0])
    one = F.flatten(F.transform(files, lambda f: F.concat(words(f), F.array(f["ending"]))))
    many = F.concat(F.transform(F.slice(files, 1, 4), telling), F.array(F.lit("bundle")))
    chosen = F.when(F.size(files) == 1, one).when(F.size(files) > 1, many).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.array_distinct(F.filter(chosen, lambda w: w != "")), "-"), F.lit("-"))


def friendly_repo(repo: Column, names: Column) -> Column:
    """A placeholder ``session-xxxx`` repository renamed after the uploaded files, its suffix kept; others as they are."""
    bare, slug = repo_name(repo), file_slug(names)
    rest = F.regexp_extract(bare, "^[^/]*/(.*)$", 1)
    suffix = F.regexp_extract(rest, r"(?:^|-)session-([A-Za-z0-9]{4,16})$", 1)
    short = F.trim(F.substring(slug, 1, 80), F.lit("-"))
    return F.when((suffix != "") & (slug != ""), F.concat(F.substring_index(bare, "/", 1), F.lit("/"), short, F.lit("-"), F.lower(suffix))).otherwise(bare)


_LOOSER = (
    ("(matched after trimming trailing whitespace)", lambda line: (line.rstrip(), 0), {}),
    ("(matched after trimming whitespace)", lambda line: (line.strip(), len(line) - len(line.lstrip())), {}),
    ("(matched after unicode normalization)", lambda line: (line.strip(), len(line) - len(line.lstrip())), PLAIN),
)


def _view(text: str, cut, plain: dict[str, str]) -> tuple[str, list[int]]:
    """The loosened text and, for each of its characters, where it stands in ``text``."""
    out, at, start = [], [], 0
    for line in text.split("\n"):
        kept, lead = cut(line)
        for i, ch in enumerate(kept):
            ch = plain.get(ch, ch)
            if ch:
                out.append(ch)
                at.append(start + lead + i)
        start += len(line) + 1
        out.append("\n")
        at.append(start - 1)
    return "".join(out[:-1]), at


def _found(text: str, what: str) -> tuple[int | None, str | None]:
    if what in text:
        return text.index(what), None
    for note, cut, plain in _LOOSER:
        view, at = _view(text, cut, plain)
        i = view.find(_view(what, cut, plain)[0])
        if i >= 0:
            return at[i], note
    return None, None


def _edited(text: str, old: str, new: str, mode: str, every: bool) -> tuple:
    if mode not in ("replace", "replace_all", "append_after", "prepend_before"):
        return None, 0, None, "unknown_mode"
    at, note = _found(text, old)
    if at is None:
        return None, 0, None, "not_found"
    if note:
        first = text.count("\n", 0, at)
        old = "\n".join(text.split("\n")[first : first + old.count("\n") + 1])
    n, every = text.count(old), every or mode == "replace_all"
    if n > 1 and mode == "replace" and not every:
        return None, n, note, "ambiguous"
    put = old + new if mode == "append_after" else new + old if mode == "prepend_before" else new
    return text.replace(old, put, -1 if every else 1), n if every else 1, note, None


def found_at(text: Column, what: Column) -> Column:
    """(at, note): offset in the text of the first match, exact, else ever looser: line ends trimmed, lines trimmed, and typographic
    characters plain. Null without one."""

    @F.pandas_udf("at int, note string")
    def find(texts: pd.Series, whats: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None or w is None else _found(t, w) for t, w in zip(texts, whats)]
        return pd.DataFrame({"at": pd.array([r[0] for r in rows], "Int32"), "note": [r[1] for r in rows]})

    return find(text, what)


def edited(text: Column, old: Column, new: Column, mode: Column, every: Column) -> Column:
    """(text, n, note, error) of an edit: ``replace``, ``replace_all``, ``append_after`` or ``prepend_before``.

    Without an exact match the whole lines of the loose match are edited. Errors are values, so one bad edit does not stop a job:
    ``not_found``, ``ambiguous`` (a single replacement of several matches), ``unknown_mode``, ``null`` (any argument null).
    """

    @F.pandas_udf("text string, n int, note string, error string")
    def edit(*columns: pd.Series) -> pd.DataFrame:
        rows = [_edited(*r[:4], bool(r[4])) if not any(pd.isna(x) for x in r) else (None, 0, None, "null") for r in zip(*columns)]
        return pd.DataFrame(rows, columns=["text", "n", "note", "error"])

    return edit(text, old, new, mode, every)
