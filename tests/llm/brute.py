"""Plain versions of operators that SQL can't express: no Spark, no Bloom filters, no partial sums."""

import math
import re

import numpy as np


def trigrams(text):
    """Three characters whose middle one is a letter; what isn't a letter is one mark."""
    codes = ["", *[c if c.isalpha() else "" for c in (text or "").lower()], ""]
    return [tuple(codes[i - 1 : i + 2]) for i in range(1, len(codes) - 1) if codes[i]]


def learned_languages(rows, least=3, share=0.5):
    """``rows`` of (id, text, lang): the typical n-grams of each language, as sets."""
    counts = {}
    for i, text, lang in rows:
        if None not in (i, text, lang):
            of = counts.setdefault(lang, {})
            for g in trigrams(text):
                of[g] = of.get(g, 0) + 1
    total = {lang: sum(of.values()) for lang, of in counts.items()}
    rate = lambda lang, g: counts[lang].get(g, 0) / total[lang]
    out = {}
    for lang, of in counts.items():
        typical = [g for g, n in of.items() if n >= least and rate(lang, g) >= share * max(rate(k, g) for k in counts)]
        if typical:
            out[lang] = set(typical)
    return out


def language_shares(text, learned):
    """Share of the text's n-grams that are typical, by language; None without a letter."""
    g = trigrams(text)
    return {lang: sum(x in of for x in g) / len(g) for lang, of in sorted(learned.items())} if g and learned else None


class BestPath:
    """Ids of the path of pieces with the greatest sum of scores, by trying every piece at every place; ties take the longest last piece."""

    def __init__(self, model):
        self.known = {p: (s, i) for i, (p, s, t) in enumerate(zip(model.pieces, model.scores, model.types, strict=True)) if t in (1, 4)}
        self.longest, self.missing, self.bytes, self.made = max(map(len, self.known)), model.missing, model.bytes, {}

    def of_word(self, word):
        best = [(0.0, [])]
        for end in range(1, len(word) + 1):
            score, ids = best[end - 1]
            now, kept = (score + self.missing, ids + [self.bytes[b] for b in word[end - 1].encode()]), True
            for start in range(max(0, end - self.longest), end):
                if (hit := self.known.get(word[start:end])) and (best[start][0] + hit[0] > now[0] or kept and best[start][0] + hit[0] >= now[0]):
                    now, kept = (best[start][0] + hit[0], best[start][1] + [hit[1]]), False
            best.append(now)
        return best[-1][1]

    def of_text(self, text):
        """Of a text without the mark of spaces; no piece goes on over a space after another character."""
        out = []
        for word in re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁")) if text else []:
            if word not in self.made:
                self.made[word] = self.of_word(word)
            out += self.made[word]
        return out


def byte_features(text):
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * 260
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper, lower = (sum(map(data.count, range(a, a + 26))) for a in (65, 97))
    gaps = sum(map(data.count, b" \t\n\x0b\f\r"))
    return [math.sqrt(data.count(i) / len(data)) for i in range(256)] + [math.log(1 + len(data)) / 10, min(50, len(data) / (gaps + 1)) / 10, 1 - len(set(lines)) / max(1, len(lines)), upper / max(1, upper + lower)]


def logistic(x, y, ridge=3.0):
    """(weights, bias) over standardized columns by Newton steps on the whole matrix."""
    x, y = np.array(x, float).reshape(-1, 260), np.array(y, float)
    if len(set(y)) < 2:
        return lambda t: math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    mean, sd = x.mean(0), x.std(0) + 1e-3
    z, w, penalty = np.c_[(x - mean) / sd, np.ones(len(x))], np.zeros(261), np.r_[np.full(260, ridge), 1e-6]
    for _ in range(60):
        p = 1 / (1 + np.exp(-(z @ w)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
    return lambda t: float(np.clip((np.array(byte_features(t)) - mean) / sd @ w[:-1] + w[-1], -30, 30))


def shrunk(groups):
    """``{key: (n, bad, parent's rate)}`` -> ``{key: posterior rate}``; the strength by the method of moments."""
    over = sum((bad - n * p) ** 2 - n * p * (1 - p) for n, bad, p in groups.values())
    pairs = sum(n * (n - 1) * p * (1 - p) for n, bad, p in groups.values())
    rho = over / pairs if pairs > 0 else 0
    strength = min(1000, max(1, 1 / rho - 1)) if rho > 0 else 1000
    return {k: (bad + strength * p) / (n + strength) for k, (n, bad, p) in groups.items()}


def quality_scores(docs, labels):
    """Scores in the order of ``docs`` (id, text, host, path); ``labels`` (id, good)."""
    labels = [x for x in labels if None not in x]
    good, texts = {}, {}
    for i, g in labels:
        good.setdefault(i, []).append(g)
    for i, text, _, _ in docs:
        texts.setdefault(i, []).append(text)
    train = [i for i in good if i in texts]
    longest = {i: max((t for t in texts[i] if t is not None), key=lambda t: t.encode(), default=None) for i in train}
    evidence = logistic([byte_features(longest[i]) for i in train], [sum(good[i]) / len(good[i]) >= 0.5 for i in train])
    seen = {}
    for i, _, host, path in docs:
        for g in good.get(i, []):
            n, bad = seen.get((host, path), (0, 0))
            seen[host, path] = n + 1, bad + 1 - g
    every, wrong = (sum(x[k] for x in seen.values()) for k in (0, 1))
    overall = (wrong + 1) / (every + 2)
    by_host = {}
    for (host, _), (n, bad) in seen.items():
        if host is not None:
            m, b, _ = by_host.get(host, (0, 0, 0))
            by_host[host] = m + n, b + bad, overall
    hosts = shrunk(by_host)
    paths = shrunk({k: (*v, hosts[k[0]]) for k, v in seen.items() if None not in k})
    out = []
    for _, text, host, path in docs:
        rate = paths.get((host, path), hosts.get(host, overall))
        odds = evidence(text) + math.log((1 - rate) / rate) - math.log((1 - overall) / overall)
        out.append(1 / (1 + math.exp(-odds)))
    return out
