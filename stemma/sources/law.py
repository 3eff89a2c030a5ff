"""The routing law's YAML subset, read on the driver: a law is a page of rules."""

from __future__ import annotations


def _scalar(text: str):
    text = text.strip()
    if text == "{}":
        return {}
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse(text: str) -> dict:
    """Mappings, sequences and ``{}``; all values stay text. A list item with a colon is a mapping."""
    rows = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
        if body.strip():
            rows.append((len(body) - len(body.lstrip()), body.strip()))

    def block(i: int, depth: int):
        if rows[i][1].startswith("- "):
            out = []
            while i < len(rows) and rows[i][0] == depth and rows[i][1].startswith("- "):
                item = rows[i][1][2:]
                if ":" in item:
                    rows[i] = (depth + 2, item)
                    value, i = block(i, depth + 2)
                else:
                    value, i = _scalar(item), i + 1
                out.append(value)
            return out, i
        made = {}
        while i < len(rows) and rows[i][0] == depth and not rows[i][1].startswith("- "):
            key, _, rest = rows[i][1].partition(":")
            i += 1
            if rest.strip():
                made[_scalar(key)] = _scalar(rest)
            elif i < len(rows) and (rows[i][0] > depth or rows[i][0] == depth and rows[i][1].startswith("- ")):
                made[_scalar(key)], i = block(i, rows[i][0])
            else:
                made[_scalar(key)] = ""
        return made, i

    return block(0, rows[0][0])[0] if rows else {}
