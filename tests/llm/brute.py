"""Plain versions of the corpus operators, and documents on which they are compared."""

import collections
import hashlib
import math
import random
import re
import zlib

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "sta", "ve") for b in ("da", "fo", "gi", "lun", "per", "t")]
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append(w.capitalize() + "." + "\n" * (rng.random() < 0.2) if i % 13 == 0 else w)
    return " ".join(out)


def edge_documents():
    """(doc_id, text, lang, source, n_chars) with nulls, ties, repeats, empty and very long texts."""
    base = prose(300, 1)
    passage = prose(40, 2)
    texts = [
        base, None, "", "   \n\t ", base.upper(), base, passage, prose(60, 3) + " " + passage + " " + prose(60, 4), prose(80, 5) + "\n" + passage,
        "aaaa " * 200, "x" * 5000, prose(60_000, 6), "é à ü ß 中文 😀 " * 30, "word", "two words", "line one is here\nline one is here\n" * 20,
        base.replace("kada", "kafo", 1), base.replace("kada", "kafo", 2), "don't it's l'eau 'tis", "api_key = 'sk_live_4f9a8b7c6d5e4f3a2b1c' commit 3f786850e387550fdab836ed7e6dc881de23001b",
    ]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, "a text without an id", None, None, None), (5, base, "en", "s1", len(base)), (5, base, "en", "s1", len(base)), (40, prose(70, 8), "de", "s9", 1)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHES = ["id", "size", "kept", "fp", "rank", "n", "spans", "head", "bin", "rid", "th", "target", "copies", "words", "text_sha256", "target_", "h", "run", "doc", "carried", "score"]


def lowered(text):
    return (text or "").encode().lower()


def exact(rows):
    groups = collections.defaultdict(list)
    for i, text, *_ in rows:
        groups[lowered(text)].append(-1 if i is None else i)
    return {t: (max(ids), len(ids)) for t, ids in groups.items()}


def fingerprint(text, width=3):
    words = lowered(text).split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, most=3):
    """Of {key: fingerprint}, the smallest key that links lead to."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def removed(docs, width):
    """Of [(order, units)] in order, flags of units covered by a window that started before."""
    seen, out = set(), {}
    for key, units in docs:
        flags = [False] * len(units)
        for p in range(len(units) - width + 1):
            w = units[p : p + width] if isinstance(units, bytes) else tuple(units[p : p + width])
            if w in seen:
                flags[p : p + width] = [True] * width
            seen.add(w)
        out[key] = flags
    return out


def measures(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = collections.Counter(windows)
    covered = {p + d for p, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def unigram(rows):
    """{row number: (held out, tokens, known, base score)} and the number of training tokens."""
    split = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    tokens = [[*lowered(t).split(), None] for _, t, *_ in rows]
    count = collections.Counter(w for own, out in zip(tokens, split, strict=True) if not out for w in own)
    n, v = sum(count.values()), len(count)
    score = [sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own) for own in tokens]
    return [(out, len(own), sum(count[w] > 0 for w in own), s) for out, own, s in zip(split, tokens, score, strict=True)], n


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def findings(text):
    """(word number, part, finding) of a text, word by word."""
    naming = r"(?i:key|secret|token|passw|passphrase|pwd|credential|auth|bearer)[A-Za-z0-9_\-]{0,40}+[\"')\]]{0,3}+ ?(?::=|=>|[=:])"
    value = r"[\"']?([^ \t\n\v\f\r\"'<>(){}\[\],;&]{6,})"
    words = re.split(r"[\x20\x09-\x0D]+", text or "")
    for no, word in enumerate(words):
        before = " ".join([words[no - d] if no >= d else "" for d in (3, 2, 1)])
        m = re.search(naming + value, word) or (re.match(value, word) if re.search(naming + "$", before) else None)
        found = re.sub("[.:]+$", "", m[1]) if m else ""
        runs = [r for r in re.findall(r"[A-Za-z0-9+/_\-]{16,}={0,2}", word) if re.search("[0-9]", r) or re.search("[a-z][A-Z]", r) and re.search("[A-Z]{2}", r)]
        yield from ((no, part, f) for part, f in enumerate([f for f in [found] if len(f) >= 6] + [r for r in runs if r not in found]))
