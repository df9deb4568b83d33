"""Plain versions of the operators, written from their contracts."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WHITE = " \t\n\x0b\x0c\r"
NULLS_FIRST = -(2**70)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeated_lines(docs, threshold=0.8):
    """{(id, text): removed line numbers}; equal rows are one document."""
    found, seen = {}, []
    unique = sorted({(i, t or "") for i, t in docs}, key=lambda d: NULLS_FIRST if d[0] is None else d[0])
    for key in unique:
        gone = []
        for number, line in enumerate(key[1].split("\n")):
            words = set(line.encode().split())
            if not words:
                continue
            if any(len(words & s) >= threshold * len(words | s) - 1e-9 for s in seen if s & words):
                gone.append(number)
            seen.append(words)
        found[key] = gone
    return found


def water_filling(totals, weights=(1, 2, 3), epochs=3.0):
    """{source: target}: clamp and reshare until none is above its cap."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = set()
    while True:
        left = sum(totals.values()) - sum(epochs * totals[s] for s in clamped)
        free = sum(weight[s] for s in totals if s not in clamped)
        target = {s: epochs * totals[s] if s in clamped else left * weight[s] / free for s in totals}
        above = {s for s in totals if s not in clamped and target[s] > epochs * totals[s]}
        if not above:
            return target
        clamped |= above


def exact_groups(docs):
    groups = defaultdict(list)
    for key, text in docs:
        text = text or ""
        groups["".join(c for c in text if c not in WHITE)].append((key, len(text)))
    found = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0] is None, -m[1], m[0] or 0))
        longest = max(n for k, n in members if (k is None) == (keep[0] is None))
        keep = min((k for k, n in members if n == longest and (k is None) == (keep[0] is None)), default=None, key=lambda k: k or 0)
        found += [(k, keep, len(members), k == keep, sha(norm)) for k, _ in members]
    return found


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        found += [(m.start(), 1, m.end())] if all(int(p) <= 255 for p in m[0].split(".")) else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        found += [(m.start(), 2, m.end())] if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        found += [(m.start(), 3, m.end())] if 10 <= len(digits(m[0])) <= 15 else []
    return sorted(found)


class ContextTree:
    """Context-tree weighting over counts of (context, bits decided) kept in a dictionary."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            line = b"\xff" * depth + text.lower() + b"\xff"
            for i in range(depth, len(line)):
                context = line[i - depth : i][::-1]
                bits = f"{line[i]:08b}"
                for level in range(depth + 1):
                    for k in range(8):
                        self.counts[context[:level], bits[:k]][int(bits[k])] += 1
                        if level:
                            self.children[context[: level - 1], bits[:k]].add(context[:level])
        self.weighted = {}

    def estimate(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weight(self, context, bits):
        node = (context, bits)
        if node not in self.weighted:
            own = self.estimate(node)
            if len(context) < self.depth:
                below = sum(self.weight(c, bits) for c in self.children[node])
                own = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            self.weighted[node] = own
        return self.weighted[node]

    def probability(self, context, bits, bit):
        """Of one decision after a context given most recent byte first."""
        path = [context[:n] for n in range(self.depth + 1) if (context[:n], bits) in self.counts]
        mixed = 0.5
        for place, node in enumerate(reversed(path)):
            counts = self.counts[node, bits]
            own = (counts[bit] + 0.5) / (sum(counts) + 1)
            if place == 0:
                mixed = own
            else:
                share = math.exp(math.log(0.5) + self.estimate((node, bits)) - self.weight(node, bits))
                mixed = share * own + (1 - share) * mixed
        return mixed

    def score(self, text):
        line, total = b"\xff" * self.depth + text.lower() + b"\xff", 0.0
        for i in range(self.depth, len(line)):
            context, bits = line[i - self.depth : i][::-1], f"{line[i]:08b}"
            total += sum(math.log10(self.probability(context, bits[:k], int(bits[k]))) for k in range(8))
        return total


def unigram(docs, training):
    """{position: (n_tokens, n_known, base score)} and the number of training tokens."""
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in docs]
    counts = Counter(w for words, learn in zip(tokens, training, strict=True) if learn for w in words)
    size = sum(counts.values()) + len(counts) + 1
    return [
        (len(words), sum(counts[w] > 0 for w in words), sum(math.log10((counts[w] + 1) / size) for w in words))
        for words in tokens
    ], sum(counts.values())


def without_repeats(texts, length):
    """(bytes, removed, spans, kept) of each text."""
    lines = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + length] for x in lines for p in range(len(x) - length + 1))
    found = []
    for x in lines:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        found.append((len(x), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), kept))
    return found


def components(n, links):
    label = list(range(n))

    def top(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        label[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def fingerprint(text, words=3, seed=42):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs, max_bits=2):
    prints = [fingerprint(t) for _, t in docs]
    n = len(docs)
    links = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= max_bits]
    top = components(n, links)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[top[i]] = min(least.get(top[i], key), key)
    return [(key, f"{prints[i]:016x}", least.get(top[i])) for i, (key, _) in enumerate(docs)]


def near_vectors(rows, threshold=0.95):
    """(n_links, component) by position; ids are unique."""
    width = max([len(v) for _, v in rows if v] or [1])
    good = [bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        if good[i]:
            unit[i, : len(v)] = np.array(v, float) / np.linalg.norm(v)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {p: i for i, p in enumerate(order)}
    top = components(len(rows), [(place[i], place[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    return [(int(near[i].sum()), rows[order[top[place[i]]]][0]) for i in range(len(rows))]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter()
    for word in words:
        padded = f" {word} "
        for n in (1, 2, 3):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1) if padded[i : i + n] != " ")
    return counts


def gram_number(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


def ranked(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], gram_number(g)))[:top]


def profiles(docs, training, top=300):
    sums = defaultdict(Counter)
    for (_, text, lang), learn in zip(docs, training, strict=True):
        if learn and text is not None and lang is not None:
            sums[lang].update(grams(text))
    return {lang: {g: i for i, g in enumerate(ranked(c, top))} for lang, c in sorted(sums.items())}


def identify(text, known, top=300):
    own = ranked(grams(text or ""), top)
    if not own or not known:
        return "und", 0.0
    distance = {
        lang: sum(min(abs(r[g] - i), top) if g in r else top for i, g in enumerate(own)) for lang, r in known.items()
    }
    best = min(distance, key=lambda lang: (distance[lang], lang))
    return best, 1 - distance[best] / (top * len(own))


def normalized(text):
    return unicodedata.normalize("NFC", text)


def planted_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_runs(words, min_length=24, min_exponent=3):
    """Every maximal run: each lag's stretches of matches, kept if no divisor of the lag is a period too."""
    numbers = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], int)
    found = []
    for lag in range(1, len(words) // min_exponent + 1):
        same = np.concatenate([[False], codes[:-lag] == codes[lag:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + lag
            if length < max(min_length, min_exponent * lag):
                continue
            part = codes[start : start + length]
            # A smaller period of so long a stretch divides the lag.
            if not any(lag % d == 0 and (part[:-d] == part[d:]).all() for d in range(1, lag)):
                found.append((start, lag, length))
    return sorted(found)


def collapsed(words, runs):
    dropped = {i for start, period, length in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)
