"""Plain single-process versions of the contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text, k=4):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def contamination(docs, benchmark, size=13):
    """{doc_id: (n_words, n_hit, items, contaminated)}"""
    wins = {}
    for item, text in benchmark:
        w = TERM.findall(lower(text))
        for s in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[s:s + size]), set()).add("" if item is None else str(item))
    lengths = {len(x) for x in wins}
    out = []
    for doc, text in docs:
        w, hit, items = TERM.findall(lower(text)), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                got = wins.get(tuple(w[s:s + n]))
                if got:
                    items |= got
                    hit |= set(range(s, s + n))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def mix_targets(sizes):
    """Targets per source name (None last) of the mixing contract."""
    names = sorted((x for x in sizes if x is not None)) + ([None] if None in sizes else [])
    goal, weight = 1.5 * sum(sizes.values()), {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    fixed, open_ = {}, set(names)
    while True:
        left, total = goal - sum(fixed.values()), sum(weight[n] for n in open_)
        over = {n for n in open_ if left * weight[n] / total > 2 * sizes[n]}
        if not over:
            return fixed | {n: left * weight[n] / total for n in open_}
        fixed |= {n: 2.0 * sizes[n] for n in over}
        open_ -= over
        if not open_:
            return fixed


def count_words(text):
    return len(WORD.findall(text or ""))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF


def repeated_words(words, k=5):
    grams = [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    return len({i + j for i, g in enumerate(grams) if g in many for j in range(k)})


def shared_passages(docs, size=50):
    """[(doc_id, spans)]: maximal word spans whose windows of ``size`` words another text, or a copy, holds too."""
    words = [(lower(t).encode("utf-8").split() if t else []) for _, t in docs]
    texts = [t for _, t in docs]
    copies = Counter(t for t in texts if t is not None)
    holders = {}
    for t, w in {t: w for t, w in zip(texts, words) if t is not None}.items():
        for i in range(len(w) - size + 1):
            holders.setdefault(tuple(w[i:i + size]), set()).add(t)
    out = []
    for (doc, t), w in zip(docs, words):
        if t is None:
            continue
        if copies[t] > 1:
            spans = [(0, len(w))] if len(w) >= size else []
        else:
            spans = []
            for i in range(len(w) - size + 1):
                if len(holders[tuple(w[i:i + size])]) > 1:
                    if spans and i <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], i + size)
                    else:
                        spans.append((i, i + size))
        if spans:
            out.append((doc, sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans)))
    return out


def quality(docs, max_docs=20, share=0.001):
    """Rows of op4 for docs (doc_id, text, source)."""
    def norm(line):
        return " ".join(WORD.findall(re.sub("[0-9]+", "0", lower(line))))

    parsed = [(d, t or "", s, [x for x in (t or "").split("\n") if WORD.search(x)]) for d, t, s in docs]
    holders, hosts = {}, {}
    for d, t, s, lines in parsed:
        for x in lines:
            holders.setdefault((s, norm(x)), set()).add((d, t))
            hosts.setdefault(s, set()).add((d, t))
    out = []
    for d, t, s, lines in parsed:
        w = WORD.findall(t)
        rep = repeated_words(w)
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        gone = sum(len(norm(x).split(" ")) for x in lines
                   if len(holders[s, norm(x)]) > max_docs and len(holders[s, norm(x)]) > share * len(hosts[s]))
        left = len(w) - gone
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, failed, gone,
                    not failed and not (gone and (left < 10 or left < len(w) * 0.5))))
    return out


def line_links(docs, threshold=0.8):
    """Rows of op1 for docs (doc_id, text) with distinct ids."""
    first, per = {}, Counter()
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        for i, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                first.setdefault(line.lower(), (d, i))
                per[d] += 1
    words = {x: tuple(WORD.findall(x)) for x in first}
    sets = {x: {w[i:i + 5] for i in range(max(1, len(w) - 4))} for x, w in words.items()}
    order = lambda at: (at[0] is not None, at[0] or 0, at[1])
    kept, links = Counter(), Counter()
    for w, s in sets.items():
        other = [v for v in sets if v != w and len(s & sets[v]) >= threshold * len(s | sets[v]) - 1e-9]
        links[first[w][0]] += len(other)
        kept[first[w][0]] += not any(order(first[v]) < order(first[w]) for v in other)
    return [(d, per[d], kept[d], per[d] - kept[d], links[d]) for d, _ in docs]


def collocations(docs, max_words=3, threshold=10, absorb=50, top=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) from (lang, text) pairs."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= threshold}
    gone = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= absorb * f[lang, w[i:i + m]]:
                    gone.add((lang, w[i:i + m]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s)
                  for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def alignment(texts, encode_a, encode_b, bytes_a, bytes_b):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per text, token by token."""
    every, held = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            every.append(None)
            continue

        def spans(ids, size):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(size[i]), i))
                at += len(size[i])
            return out
        sa, sb = spans(a, bytes_a), spans(b, bytes_b)
        common = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        links, j = [], 0
        for s, e, i in sa:
            while sb[j][1] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((i, sb[k][2]))
                k += 1
        held.update(set(links))
        at, groups = 0, []
        for end in common:
            groups.append(",".join(str(i) for s, e, i in sa if at <= s < end) + "|" + ",".join(str(i) for s, e, i in sb if at <= s < end))
            at = end
        every.append((len(a), len(b), groups, links))
    best = {}
    for (i, _), c in held.items():
        best[i] = max(best.get(i, 0), c)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], len(x[2]), len(x[3]), sum(held[p] == best[p[0]] for p in x[3]), sum(held[p] for p in x[3]),
             hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in every]
