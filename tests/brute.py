"""Plain Python versions of the core problem operators, for small inputs."""

from __future__ import annotations

import json
import re

SEPARATORS = ",;|\n\r\t·•"


def split(text):
    """The values of a packed text, read character by character."""
    if text is None:
        return []
    bare = text.strip()
    if bare.startswith("[") and not bare.startswith("[[") and bare.endswith("]"):
        try:
            return [v.strip() for v in json.loads(bare) if v is not None and v.strip()]
        except ValueError:
            pass
    items, cur, i = [], "", 0
    while i < len(text):
        c = text[i]
        opens = not re.sub(r"^\s*([-*+]\s+)?", "", cur)
        if text.startswith("[[", i) and "]]" in text[i:]:
            end = text.index("]]", i) + 2
            cur, i = cur + text[i:end], end
        elif opens and c in "\"'":
            m = re.compile(f"{c}(?:[^{c}]|{c}{c})*{c}(?=[^\\S\n\r\t]*(?:[,;|\n\r\t·•]|<br\\s*/?>|$|(?<=\\s)/\\s))").match(text, i)
            cur, i = cur + (m[0] if m else c), m.end() if m else i + 1
        elif c in SEPARATORS:
            items.append(cur)
            cur, i = "", i + 1
        elif m := re.compile(r"<br\s*/?>").match(text, i):
            items.append(cur)
            cur, i = "", m.end()
        elif c == "/" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace():
            items.append(cur)
            cur, i = "", i + 1
        else:
            cur, i = cur + c, i + 1
    out = []
    for v in [*items, cur]:
        v = re.sub(r"^\s*([-*+]\s+)?", "", v).strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
            v = v[1:-1].replace(v[0] * 2, v[0]).strip()
        if v and v not in "-*+":
            out.append(v)
    return out


def is_link(v):
    return v.startswith(("[[", "![[")) and v.endswith("]]")


def key(v):
    v = v.strip()
    if is_link(v):
        v = v[v.index("[[") + 2 :].split("]]")[0]
    v = v.split("|")[0].rstrip("\\ ").split("#")[0].split("/")[-1].strip().lower()
    return (v[:-3] if v.endswith(".md") else v).strip()


def ancestors(links):
    """{(node, ancestor, steps)} of (node, parent) pairs."""
    nodes = {n for n, _ in links if n is not None}
    up = dict.fromkeys(nodes)
    for n, p in links:
        if n is not None and p in nodes and (up[n] is None or p < up[n]):
            up[n] = p
    out = set()
    for n in nodes:
        walk, x = [], n
        while x is not None and x not in walk:
            walk.append(x)
            x = up[x]
        if x is None:
            out |= {(n, a, i) for i, a in enumerate(walk)}
        else:
            out.add((n, min(walk[walk.index(x) :]), -1))
    return out
