"""Plain sequential versions of the matching, for comparison on small tables."""

from __future__ import annotations

from collections import Counter


def jaro_winkler(a, b):
    """Textbook form with used flags."""
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    hit_a, hit_b = [False] * len(a), [False] * len(b)
    for i, ch in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not hit_b[j] and b[j] == ch:
                hit_a[i] = hit_b[j] = True
                break
    x = [c for c, h in zip(a, hit_a) if h]
    y = [c for c, h in zip(b, hit_b) if h]
    if not x:
        return 0.0
    m, t = len(x), sum(p != q for p, q in zip(x, y)) // 2
    score = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if score > 0.7:
        p = 0
        while p < min(4, len(a), len(b)) and a[p] == b[p]:
            p += 1
        score += 0.1 * p * (1 - score)
    return score


def bigram_cosine(a, b):
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (f" {a} ", f" {b} "))
    norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(n * y[g] for g, n in x.items()) / norm


def text(name, value):
    if isinstance(value, (int, float)):
        return [f"{name}: {float(value):.2f}"]
    return [f"{name}: {value.strip().lower()}"] * (3 if "id" in name.lower() else 1)


def id_text(value):
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value).strip().lower()


def score(left, right, matches):
    """(score, whether an identifier is equal) of two rows given as dicts."""
    got = weights = 0.0
    same_id = False
    for a, b in matches.items():
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        if "id" in a.lower():
            equal = id_text(x) == id_text(y)
            same_id |= equal
            sim, weight = float(equal), 5.0
        elif isinstance(x, (int, float)) and isinstance(y, (int, float)):
            top = max(abs(x), abs(y))
            sim, weight = (1.0 - abs(x - y) / top if top else 1.0), 2.0
        else:
            sim, weight = jaro_winkler(str(x).strip().lower(), str(y).strip().lower()), 1.0
        got += weight * sim
        weights += weight
    texts = (
        " | ".join(p for n in names for p in (text(n, row[n]) if row[n] is not None else []))
        for row, names in ((left, matches.keys()), (right, matches.values()))
    )
    field = got / weights if weights else 0.0
    return round(0.3 * bigram_cosine(*texts) + 0.7 * field, 9), same_id


def greedy(edges):
    """Sequential pass over (score, left, right), highest first."""
    used_left, used_right, taken = set(), set(), []
    for s, i, j in sorted(edges, reverse=True):
        if i not in used_left and j not in used_right:
            used_left.add(i)
            used_right.add(j)
            taken.append((i, j, s))
    return sorted(taken)


def match(left, right, matches, threshold, left_key, right_key):
    """Compare every pair of rows, then assign greedily."""
    edges = []
    for x in left:
        for y in right:
            s, same_id = score(x, y, matches)
            if s >= threshold:
                edges.append((1.0 if same_id else s, x[left_key], y[right_key]))
    return greedy(edges)
