"""Plain versions of the operators for small tables, and texts that are hard to handle."""

import re

HARD_TEXTS = [
    None,
    "",
    " ",
    "\n\n \t",
    "one",
    "one two",
    "It's a DON'T we'll test, isn't it?  ''s 'sleep",
    "Straße ÉÀÇ ﬁn İstanbul ΣΑΣ x\x1fy KÅ",
    "áb ë ≠ ́start",
    "日本語 テキスト 😀👍🏽 ok　wide thin\xa0hard",
    "12345 6 78,9.0 ½ ² ٣٤ 1st a1b2",
    "___ a_b --- <|endoftext|> ## $$$ %%%word",
    "tabs\tand\x0bvertical\x0cfeeds\r\nlines\n\n\nend ",
    "x" * 3000,
    "ab" * 50 + " " * 300 + "!" * 200 + "7" * 100,
    "word " * 400,
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, size):
    w = words(text)
    if not w:
        return set()
    if len(w) < size:
        return {tuple(w)}
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def groups(rows, size, percent):
    """Rows (doc_id, text) as (doc_id, set size, smallest doc_id of the component), sorted."""
    sets = [shingles(text, size) for _, text in rows]
    head = list(range(len(rows)))

    def top(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                head[top(a)] = top(b)
    least = {}
    for x, (doc_id, _) in enumerate(rows):
        least[top(x)] = min(least.get(top(x), doc_id), doc_id)
    return sorted((rows[x][0], len(sets[x]), least[top(x)]) for x in range(len(rows)))


def base_secrets(text):
    """(kind, start, end) of the base kinds by the patterns alone, over the whole text."""
    assign = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    found = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)):
        found += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
