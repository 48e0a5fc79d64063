"""Small documents with every edge, and brute-force versions of the contracts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = " ".join(f"shared{i}" for i in range(60))
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))


def documents(spark):
    """Nulls in every column, empty and long texts, exact and near copies, repeated rows and ids, columns with clashing names."""
    near = [" ".join(f"n{i}" if i != 7 * k else f"edit{k}" for i in range(120)) for k in range(12)]
    texts = [None, "", "   \n\t ", "one", "one two", "One TWO three", LONG, "a\n\nb\n a \nA", *near, *([near[3]] * 6)]
    texts += [f"lead{i} {PASSAGE} tail{i} end{i}" for i in range(5)] + ["Same LINE\nrare %d\n\tsame line " % i for i in range(14)]
    texts += ["x y " * 60, "É été  naïve \x0b\x1c漢字 한국 1234 don't we'll it's 'S 　 end  ", "tail space  ", "CC BY 4.0, GNU General Public License; all rights reserved cc by"]
    rows = [(i, t, "en" if i % 2 else None, "src" if i % 3 else None, len(t) if t is not None else None, "h", 7, b"c", [i]) for i, t in enumerate(texts)]
    rows += [(None, "one two", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), rows[8], rows[8], (3, "another text of id three", None, None, None, "k", 1, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, key int, block binary, `odd name.x` array<long>")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def line_keys(text: str | None) -> list[str]:
    return [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (text or "").split("\n")]


def dropped_lines(texts: list[str | None], min_docs: int) -> set[str]:
    counts = Counter(k for t in texts for k in set(line_keys(t)) if k)
    return {k for k, n in counts.items() if n >= min_docs}


def uncovered(texts: list[str | None], size: int) -> list[list[str]]:
    """Each text's words that no repeated window covers."""
    all_words = [words(t) for t in texts]
    counts = Counter(tuple(w[i : i + size]) for w in all_words for i in range(len(w) - size + 1))
    out = []
    for w in all_words:
        gone = {j for i in range(len(w) - size + 1) if counts[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def shingles(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts: list[str | None], n: int, percent: int) -> list[int]:
    """For each text the number of its component's first text, by pairs that share a shingle."""
    sets, parent = [shingles(t, n) for t in texts], list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    postings = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            postings[x].append(i)
    for i, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in postings[x] if j > i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]
