"""Plain versions of the operators, for comparison on small tables."""

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def near_duplicates(docs, n, percent=80):
    """{doc_id: (n_shingles, component)} of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    ids = sorted(sets)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    found = components(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def base_spans(text):
    kinds = (
        ("assign", re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
    )
    out = []
    for k, (name, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(name, a, b) for a, _, b, name in sorted(out)]
