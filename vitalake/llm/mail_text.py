"""Readable text of raw mail messages: transfer encodings, mark-up and encoded words undone.

A transfer encoding holds for the part whose headers name it: from the blank line after them to the next
boundary line (of any multipart, closed or not) or the end. Headers may be folded, quoted or in any letter case,
and a quoted or forwarded part is treated like any other. Bytes are read in the charset that the part's headers
name; where they name none, or it does not fit, as UTF-8 and then as Windows Latin. Encoded words of headers are
decoded wherever they stand. Base64 lines that no header announces are decoded if the message names that encoding
anywhere and they hold text. Whatever cannot be decoded stays as it is.
"""

from __future__ import annotations

import base64
import binascii
import html
import re

_SOFT = re.compile(r"=[ \t]*\r?\n")
_QP = re.compile(r"(?:=[0-9A-Fa-f]{2})+")
_B64 = re.compile(r"(?:^[A-Za-z0-9+/]{32,}={0,2}\r?\n)+^[A-Za-z0-9+/]{2,}={0,2}\r?$|^[A-Za-z0-9+/]{8,}={0,2}\r?$", re.M)
_BINARY = re.compile(rb"[\x00-\x08\x0e-\x1f]")
_ENCODING = re.compile(r"^[> \t]*content-transfer-encoding[ \t]*:\s*[\"']?(base64|quoted-printable)", re.I | re.M)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_MARK = re.compile(r"^[> \t]*>[ \t]?", re.M)
_BLANK = re.compile(r"^[> \t]*\r?$\n?", re.M)
_BOUNDARY = re.compile(r"^[> \t]*--[^\s-].*$", re.M)
_WORD = re.compile(r"=\?([\w.:-]+)(?:\*[\w-]+)?\?([bBqQ])\?([^?\s]*)\?=(?:\s+(?==\?))?")


def _bytes(raw: bytes, charset: str | None = None) -> str:
    for name in (charset, "utf-8"):
        try:
            if name:
                return raw.decode(name)
        except (UnicodeDecodeError, LookupError, ValueError):
            pass
    return raw.decode("cp1252", "replace")


def _quoted(text: str, charset: str | None = None) -> str:
    return _QP.sub(lambda m: _bytes(bytes.fromhex(m.group().replace("=", "")), charset), _SOFT.sub("", text))


def _b64(block: str, charset: str | None, announced: bool) -> str:
    """The text of a run of base64 lines; a blank for attachments, the run itself where it is none."""
    if not announced and len(block) < 40 and not block.endswith("="):
        return block
    data = re.sub(r"\s+", "", block)
    if not announced and len(data) < 60 and "\n" not in block and not data.endswith("="):
        return block
    try:
        raw = base64.b64decode(data + "=" * (-len(data) % 4))
    except (binascii.Error, ValueError):
        return block
    if (charset or "").lower().startswith(("utf-16", "utf-32")):
        return _bytes(raw, charset)
    if _BINARY.search(raw):
        return " "
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        # a cut block may end inside a character
        if e.start >= len(raw) - 4:
            return raw[: e.start].decode("utf-8")
        text = _bytes(raw, charset)
        return text if sum(c.isalnum() or c.isspace() for c in text) > 0.8 * len(text) else " "


def _encoded_word(m: re.Match) -> str:
    charset, kind, data = m.groups()
    try:
        raw = base64.b64decode(data + "=" * (-len(data) % 4)) if kind in "bB" else binascii.a2b_qp(data.replace("_", " "))
        return raw.decode(charset)
    except (binascii.Error, ValueError, LookupError):
        return m.group()


def _parts(text: str) -> str:
    """The text with each part decoded as its headers say."""
    out, at = [], 0
    for m in _ENCODING.finditer(text):
        if m.start() < at:
            continue
        blank = _BLANK.search(text, m.end())
        if not blank:
            continue
        end = _BOUNDARY.search(text, blank.end())
        z = end.start() if end else len(text)
        # the headers of this part: up to the blank line or boundary before
        before = [x.end() for p in (_BLANK, _BOUNDARY) for x in p.finditer(text, at, max(at, m.start() - 1))]
        charset = _CHARSET.search(text, max(before, default=at), blank.start())
        name = charset.group(1) if charset else None
        body = text[blank.end() : z]
        if m.group().lstrip(" \t").startswith(">"):
            body = _MARK.sub("", body)
        if m.group(1).lower() == "base64":
            body = _B64.sub(lambda b, name=name: _b64(b.group(), name, True), body)
        else:
            body = _quoted(body, name)
        out += [text[at : blank.end()], body]
        at = z
    return "".join([*out, text[at:]])


def _untagged(text: str) -> str:
    """Tags as blanks, whatever their length; a bracket that no other closes stays."""
    out, at = [], 0
    while (a := text.find("<", at)) >= 0:
        z = text.find(">", a + 1)
        if z < 0:
            break
        # the last bracket before the closing one begins the tag
        a = text.rfind("<", a, z)
        if (c := text[a + 1 : a + 2]).isalpha() or c == "!" or c == "/" and text[a + 2 : a + 3].isalpha():
            out += [text[at:a], " "]
        else:
            out.append(text[at : z + 1])
        at = z + 1
    return "".join([*out, text[at:]])


def readable(text: str) -> str:
    """The text with base64 and quoted-printable parts decoded, tags dropped and references resolved."""
    low = text.lower()
    if "content-transfer-encoding" in low:
        text = _parts(text)
    if "base64" in low:
        text = _B64.sub(lambda m: _b64(m.group(), None, False), text)
    if "=?" in text:
        text = _WORD.sub(_encoded_word, text)
    if "<" in text:
        text = _untagged(text)
    if "&" in text:
        text = html.unescape(text)
    return text
