"""The own words of an archived message: its body, decoded and as displayed, without headers, quotes, attachments, signature and disclaimer."""

from __future__ import annotations

import base64
import html
import quopri
import re

_HEADER = re.compile(r"(?:>?From |[A-Za-z][A-Za-z0-9-]*:)")
_HEADER_LINE = re.compile(r"^[A-Za-z][A-Za-z-]{1,30}: ?\S.*$")
_FOLD = re.compile(r"\n[ \t]+")
_TYPE = re.compile(r"(?im)^content-type:[ \t]*([^;\n]*)")
_BOUNDARY = re.compile(r'(?i)\bboundary="?([^";\n]+)')
_ENCODING = re.compile(r"(?im)^content-transfer-encoding:[ \t]*([\w-]+)")
_DISPOSITION = re.compile(r"(?im)^content-disposition:[ \t]*(\w+)")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_SCRIPT = re.compile(r"(?is)<(script|style|head)\b.*?</\1\s*>")
_QUOTE_TAG = re.compile(r"(?is)<blockquote\b.*?(?:</blockquote\s*>|\Z)")
_LINK_OPEN = re.compile(r"(?i)<a\b[^>]*>")
_LINK_CLOSE = re.compile(r"(?i)</a\s*>")
_BLOCK = re.compile(r"(?i)</?(?:p|li|td|tr|th|div|br|ul|ol|table|h\d|body|html|hr)\b[^>]*>")
_TAG = re.compile(r"<[/!a-zA-Z][^>]*>")
_RULE = re.compile(r"^_{5,}\s*$|^-- ?$")
_FORWARD = re.compile(r"^-{4,} ?[^-]+ ?-{4,}$")

#: Marks around the text of a link in displayed HTML.
LINK, END = "\x02", "\x03"
_DEEPEST = 8


def _decode(body: str, encoding: str) -> str:
    if encoding == "base64":
        packed = _NOT_BASE64.sub("", body)
        raw = base64.b64decode(packed[: len(packed) // 4 * 4])
    elif encoding == "quoted-printable":
        raw = quopri.decodestring(body.encode("utf-8", "replace"))
    else:
        return body
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "ignore") if len(raw) and len(raw.decode("utf-8", "ignore")) > 0.97 * len(raw.decode("latin-1")) else raw.decode("latin-1")


def _split(text: str) -> tuple[str, str]:
    if not _HEADER.match(text):
        return "", text
    end = text.find("\n\n")
    return (text, "") if end < 0 else (text[:end], text[end + 2 :])


def text_parts(text: str, depth: int = 0) -> list[tuple[str, str]]:
    """(type, decoded text) of the displayed parts; attachments are left out. A body without its end is taken as far as it goes."""
    head, body = _split(text)
    head = _FOLD.sub(" ", head)
    kind = (m.group(1).strip().lower() if (m := _TYPE.search(head)) else "") or "text/plain"
    if kind.startswith("multipart/") and (m := _BOUNDARY.search(head)) and depth < _DEEPEST:
        out = []
        for part in body.split("--" + m.group(1))[1:]:
            if part.startswith("--"):
                break
            out += text_parts(part[1:] if part.startswith("\n") else part, depth + 1)
        if out and kind == "multipart/alternative":  # the same words twice
            return [max(out, key=lambda p: (p[0] == "text/html" and bool(p[1].strip()), len(p[1])))] if any(p[0] == "text/html" for p in out) else out[:1]
        return out if out or not body.strip() or "--" + m.group(1) in body else [("text/plain", body)]
    if (m := _DISPOSITION.search(head)) and m.group(1).lower() == "attachment" or not kind.startswith(("text/", "message/")):
        return []
    encoding = m.group(1).lower() if (m := _ENCODING.search(head)) else ""
    body = _decode(body, encoding).replace("\r\n", "\n")
    if kind.startswith("message/") and depth < _DEEPEST:
        return text_parts(body, depth + 1)
    return [("text/html" if kind == "text/html" else "text/plain", body)]


def displayed(markup: str) -> str:
    """Text of HTML, a block to a line, links marked."""
    x = _QUOTE_TAG.sub("\n", _SCRIPT.sub(" ", markup))
    x = _LINK_CLOSE.sub(END + " ", _LINK_OPEN.sub(" " + LINK, x))
    return html.unescape(_TAG.sub("", _BLOCK.sub("\n", x)))


def own_lines(text: str) -> list[str]:
    """Lines of the message's own words; an empty line ends a paragraph."""
    out: list[str] = []
    for kind, body in text_parts(text.replace("\r\n", "\n")):
        if kind == "text/html":
            body = displayed(body)
        if "\n>" in body or body.startswith(">"):
            body = re.sub(r"(?m)^[ \t]*>.*$", "", body)
        lines = body.split("\n")
        i = 0
        while i < len(lines):
            s = lines[i].strip()
            if _RULE.match(s):  # signature or disclaimer: to the end of the part, or to a message forwarded below
                while i < len(lines) and not _FORWARD.match(lines[i].strip()):
                    i += 1
                continue
            if _FORWARD.match(s):
                i += 1
                while i < len(lines) and _HEADER_LINE.match(lines[i].strip()):
                    i += 1
                continue
            out.append(s)
            i += 1
        out.append("")
    return out
