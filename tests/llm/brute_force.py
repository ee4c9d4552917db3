"""Plain definitions that operators are held against."""


def brute_components(texts, width, num, den):
    sets = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets[i] = {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if n else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def brute_removed(rows, length=50):
    first = {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        data = text.encode()
        for s in range(len(data) - length + 1):
            first.setdefault(data[s:s + length], i)
    out = []
    for i, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if first[data[s:s + length]] < i:
                gone[s:s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, kept))
    return sorted(out)
