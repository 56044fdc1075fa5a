"""A plain model of the chunker, for comparison."""

import re

MARK = re.compile(r"<!--[\s]*page_number:[\s]*(\d+)[\s]*-->")
HEAD = re.compile(r"^(##{0,5})\s+(.+)$", re.M)


def chunks(text):
    heads = list(HEAD.finditer(text))
    cuts = [m.start() for m in heads] + [len(text)]
    out, path = [], []
    if not heads or text[: cuts[0]].strip():
        out.append((MARK.sub("", text[: cuts[0]]).strip(), None, 0, "", sorted({1} | {int(m[1]) for m in MARK.finditer(text, 0, cuts[0])})))
    for m, a, b in zip(heads, cuts, cuts[1:]):
        level, title = len(m[1]), m[2].strip()
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, title))
        before = [int(x[1]) for x in MARK.finditer(text, 0, a)]
        inside = {int(x[1]) for x in MARK.finditer(text) if a <= x.start() < b}
        out.append((MARK.sub("", text[a:b]).strip(), title, level, " > ".join(t for _, t in path), sorted(inside | {before[-1] if before else 1})))
    return out
