"""Plain re-statements of the contracts, for small tables, and the odd documents they are tried on."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, norm int, comp string, row long, kept boolean, text_sha256 string, _k string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_documents(seed, n=120):
    """Rows with nulls, blank and very long texts, copies, near copies, shared passages, repeated rows, and columns whose names clash."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("ab", "Co", "dé", "fu", "gä", "hi") for b in ("", "ra", "to", "ne", "x1")]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(17)
    texts = [None, "", "  \t\n ", "one", "One\vtwo", "ONE two", "one  two", text(12), text(13), text(3000)]
    while len(texts) < n:
        kind, old = rng.randrange(7), rng.choice(texts) or "x"
        if kind == 0:
            texts.append(old)
        elif kind == 1:
            texts.append(old.replace(" ", "\n\t"))
        elif kind == 2:
            w = old.split()
            texts.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.03 else x for x in w))
        elif kind == 3:
            texts.append(f"{text(rng.randrange(9))} {passage} {text(rng.randrange(9))}")
        else:
            texts.append(text(rng.randrange(60)))
    rng.shuffle(texts)
    ids = rng.sample(range(-50, 5000), len(texts))
    rows = [(i, t, rng.choice(["aa", "bb", None]), rng.choice(["s", None]), None if t is None else len(t), "c", None, "c", 7, None, "mine", "k") for i, t in zip(ids, texts)]
    rows += [rows[3], rows[3], rows[50]]  # repeated rows
    rows += [(None, rows[4][1], *rows[4][2:]), (None, None, *rows[0][2:]), (None, text(20), *rows[1][2:])]
    return rows


def last(i):
    """Order of identifiers: null after all others."""
    return (i is None, i or 0)


def exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for k, t in enumerate(norm):
        groups.setdefault(t, []).append(k)
    out = []
    for t, members in groups.items():
        first = min(members, key=lambda k: last(rows[k][0]))
        keep = rows[first][0]
        stays = [k for k in members if rows[k][0] == keep][0]
        out += [(rows[k][0], keep, len(members), k == stays, sha(t)) for k in members]
    return out


def substring(rows):
    seen = {}
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            seen[key] = min(seen.get(key, r[0]), r[0], key=last)
    out = []
    for r in rows:
        w = words(r[1])
        gone = set()
        for k in range(len(w) - 12):
            if last(seen[tuple(w[k : k + 13])]) < last(r[0]):
                gone.update(range(k, k + 13))
        out.append((r[0], len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def contamination(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for k in range(max(len(w) - 9, min(1, len(w)))):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str("null" if item is None else item))
    out = []
    for r in rows:
        w = split(r[1])
        hit, found = set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (got := windows.get(tuple(w[k : k + n]))):
                    hit.update(range(k, k + n))
                    found |= got
        out.append((r[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def shingles(text, size):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def linked(a, b, percent=80):
    both = len(a & b)
    return bool(a and b) and 100 * both >= percent * (len(a) + len(b) - both)


def near(rows, size):
    sets = [shingles(r[1], size) for r in rows]
    named = {}
    for k, r in enumerate(rows):
        if r[0] is not None and sets[k]:
            named.setdefault(sets[k], []).append(r[0])
    above = {i: i for ids in named.values() for i in ids}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    def join(i, j):
        i, j = sorted((top(i), top(j)))
        above[j] = i

    every = list(named)
    for a, x in enumerate(every):
        for i in named[x][1:]:
            join(named[x][0], i)
        for y in every[a + 1 :]:
            if linked(x, y):
                join(named[x][0], named[y][0])
    out = []
    for k, r in enumerate(rows):
        comp = top(named[sets[k]][0]) if sets[k] in named else r[0]
        out.append((r[0], len(sets[k]), comp, comp == r[0]))
    return out


def trigrams(text):
    """Counts of hashed letter trigrams, one character after another."""
    out, spaced = {}, " "
    for c in text or "":
        c = c.lower()[0] if c.isalpha() else " "
        if c != " " or spaced[-1] != " ":
            spaced += c
    spaced = spaced if spaced[-1] == " " else spaced + " "
    for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
        h = (ord(a) * 0x9E3779B1 & 0xFFFFFFFF) ^ (ord(b) * 0x85EBCA77 & 0xFFFFFFFF) ^ (ord(c) * 0xC2B2AE3D & 0xFFFFFFFF)
        h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
        out[h >> 16] = out.get(h >> 16, 0) + 1
    return out


def mixture(likelihood, counts):
    """Proportions by EM from even ones, and the log-likelihood.  likelihood[language][value], counts[value]."""
    from math import log

    k, total = len(likelihood), sum(counts.values())
    w = [1 / k] * k
    for _ in range(30 if k > 1 else 0):
        new = [0.0] * k
        for v, n in counts.items():
            joint = [w[j] * likelihood[j](v) for j in range(k)]
            for j in range(k):
                new[j] += n * joint[j] / sum(joint) / total
        moved = max(abs(a - b) for a, b in zip(w, new))
        w = new
        if moved < 1e-3:
            break
    return w, sum(n * log(sum(w[j] * likelihood[j](v) for j in range(k))) for v, n in counts.items())


def languages(rows):
    """(doc_id, held out, language, score, {language: share}) of rows (doc_id, text, lang)."""
    import zlib
    from math import exp, log

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0
    learned = {}
    for i, text, lang in rows:
        if not held(i) and text is not None and lang is not None:
            for v, n in trigrams(text).items():
                counts = learned.setdefault(lang, {})
                counts[v] = counts.get(v, 0) + n
    names = sorted(learned)
    sums = {x: sum(learned[x].values()) + 0.05 * 65536 for x in names}
    model = {x: (lambda v, x=x: (learned[x].get(v, 0) + 0.05) / sums[x]) for x in names}
    out = []
    for i, text, _ in rows:
        counts = trigrams(text)
        if not counts or not names:
            out.append((i, held(i), "und", 0.0, {}))
            continue
        alone = {x: sum(n * log(model[x](v)) for v, n in counts.items()) for x in names}
        first = max(names, key=lambda x: (alone[x], -names.index(x)))
        shares = dict(zip(names, mixture([model[x] for x in names], counts)[0]))
        order = [first] + sorted((x for x in names if x != first), key=lambda x: -shares[x])
        penalty = 0.5 * log(max(2, sum(counts.values())))
        chosen, weights, value = [first], [1.0], alone[first] / 3
        rival = max((alone[x] / 3 for x in names if x != first), default=None)
        for k in range(2, len(names) + 1):
            w, likelihood = mixture([model[x] for x in order[:k]], counts)
            now = likelihood / 3 - penalty * (k - 1)
            if now <= value:
                rival = max(rival, now)
                break
            rival, chosen, weights, value = value, order[:k], w, now
        sure = 1.0 if rival is None else 1 / (1 + exp(min(0.0, max(-700.0, rival - value))))
        best = max(range(len(chosen)), key=lambda j: weights[j])
        out.append((i, held(i), chosen[best], min(1.0, weights[best] * sure), dict(zip(chosen, weights))))
    return out
