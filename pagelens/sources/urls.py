"""URLs as browsers read them: parts, dot segments, percent-encoding by part, IPv4 and IPv6 hosts, punycode."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default ports, and the characters that a part escapes besides controls and everything beyond "~".
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
FRAGMENT = ' "<>`'
QUERY = ' "#<>'
SPECIAL_QUERY = QUERY + "'"
PATH = QUERY + "?^`{}"
USER = PATH + "/:;=@[\\]|"
NO_HOST = "\0\t\n\r #/:<>?@[\\]^|"

_SPACE = " \t\n\x0b\x0c\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_EDGE = "".join(map(chr, range(0x21)))
_DOT = re.compile(r"(?i)(?:\.|%2e)")


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: tuple[str, ...] | str = ()  # a text if it can't be split, as in mailto:
    query: str | None = None
    fragment: str | None = None

    @property
    def special(self) -> bool:
        return self.scheme in PORTS

    def __str__(self) -> str:
        out = self.scheme + ":"
        if self.host is not None:
            user = f"{self.user}{':' + self.password if self.password else ''}@" if self.user or self.password else ""
            out += f"//{user}{self.host}{'' if self.port is None else f':{self.port}'}"
        elif not isinstance(self.path, str) and len(self.path) > 1 and not self.path[0]:
            out += "/."
        out += self.path if isinstance(self.path, str) else "".join("/" + s for s in self.path)
        return out + ("" if self.query is None else "?" + self.query) + ("" if self.fragment is None else "#" + self.fragment)


def escape(text: str, extra: str) -> str:
    if text.isascii() and not any(c in extra or c < " " or c == "\x7f" for c in text):
        return text
    return "".join(c if " " <= c < "\x7f" and c not in extra else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def unescape(text: str) -> str:
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "replace"))
    return raw.decode("utf-8", "replace")


def ascii_host(host: str) -> str | None:
    """Lower case and compatibility forms; labels beyond ASCII in punycode."""
    if host.isascii():
        return host.lower()
    host = re.sub("[\u00ad\u200b\u2060\ufeff]", "", unicodedata.normalize("NFKC", re.sub("[\u3002\uff0e\uff61]", ".", host)).lower())
    try:
        return ".".join(label if label.isascii() else "xn--" + unicodedata.normalize("NFC", label).encode("punycode").decode() for label in host.split("."))
    except UnicodeError:
        return None


def _number(part: str) -> int | None:
    if not part:
        return None
    base, digits = (16, part[2:]) if part[:2].lower() == "0x" else (8, part[1:]) if len(part) > 1 and part[0] == "0" else (10, part)
    if not digits:
        return 0
    return int(digits, base) if re.fullmatch({16: "[0-9A-Fa-f]+", 8: "[0-7]+", 10: "[0-9]+"}[base], digits) else None


def ipv4(host: str) -> str | None:
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def ipv6(text: str) -> str | None:
    head, gap, tail = text.partition("::")
    if "::" in tail:
        return None

    def pieces(side: str, last: bool) -> list[int] | None:
        out: list[int] = []
        parts = side.split(":") if side else []
        for i, p in enumerate(parts):
            if "." in p and last and i == len(parts) - 1:
                octets = p.split(".")
                if len(octets) != 4 or any(not re.fullmatch("0|[1-9][0-9]{0,2}", o) or int(o) > 255 for o in octets):
                    return None
                a, b, c, d = map(int, octets)
                out += [a << 8 | b, c << 8 | d]
            elif re.fullmatch("[0-9A-Fa-f]{1,4}", p):
                out.append(int(p, 16))
            else:
                return None
        return out

    left, right = pieces(head, not gap), pieces(tail, True)
    if left is None or right is None or (len(left) + len(right) > 7 if gap else len(left) != 8):
        return None
    words = left + [0] * (8 - len(left) - len(right)) + right
    runs = [(len(m[0]), -m.start()) for m in re.finditer("1{2,}", "".join("10"[w > 0] for w in words))]
    shown = [f"{w:x}" for w in words]
    if not runs:
        return f"[{':'.join(shown)}]"
    n, at = max(runs)
    return f"[{':'.join(shown[:-at])}::{':'.join(shown[-at + n:])}]"


def host_of(text: str, special: bool) -> str | None:
    """None if it can't be a host."""
    if text.startswith("["):
        return ipv6(text[1:-1]) if text.endswith("]") else None
    if not special:
        return None if any(c in NO_HOST for c in text) else escape(text, "")
    host = ascii_host(unescape(text))
    if not host or any(c in NO_HOST or c < " " or c in "%\x7f" for c in host):
        return None
    last = host.rstrip(".").rpartition(".")[2] if host.endswith(".") and host != "." else host.rpartition(".")[2]
    return ipv4(host) if re.fullmatch("[0-9]+|0[xX][0-9A-Fa-f]*", last) else host


def _tail(url: Url, text: str, kept: tuple[str, ...]) -> Url:
    """url with the path, query and fragment that text has; the path goes on from ``kept``."""
    text, mark, fragment = text.partition("#")
    fragment = escape(fragment, FRAGMENT) if mark else None
    text, mark, query = text.partition("?")
    query = escape(query, SPECIAL_QUERY if url.special else QUERY) if mark else None
    path = list(kept)
    parts = re.split(r"[/\\]" if url.special else "/", text)
    for i, part in enumerate(parts):
        dots, last = _DOT.sub(".", part), i == len(parts) - 1
        if dots == "..":
            del path[-1:]
        if dots in (".", ".."):
            path += [""] if last else []
        else:
            path.append(escape(part, PATH))
    return replace(url, path=tuple(path), query=query, fragment=fragment)


def _after_authority(url: Url, text: str) -> Url | None:
    m = re.match(r"[^/?#\\]*" if url.special else "[^/?#]*", text)
    authority, text = m[0], text[m.end():]
    login, at, place = authority.rpartition("@")
    user, _, password = login.partition(":")
    m = re.fullmatch(r"(\[[^\]]*\]?|[^:]*)(?::(.*))?", place)
    if not m or m[2] and not re.fullmatch("[0-9]+", m[2]) or not m[1] and (url.special or at or m[2] is not None):
        return None
    port = int(m[2]) if m[2] else None
    host = host_of(m[1], url.special) if m[1] else ""
    if host is None or port is not None and port > 65535:
        return None
    out = replace(url, user=escape(user, USER), password=escape(password, USER), host=host, port=None if port == PORTS.get(url.scheme) else port)
    if not text or text[0] in "?#":
        return _tail(out, text[0:], ()) if url.special else replace(_tail(out, "/" + text, ()), path=())
    return _tail(out, text[1:], ())


def parse(text: str, base: Url | None = None) -> Url | None:
    """None for what a browser refuses, too."""
    text = re.sub("[\t\n\r]", "", text.strip(_EDGE))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    slash = re.compile(r"[/\\]")
    if m:
        scheme, rest = m[1].lower(), text[m.end():]
        url = Url(scheme)
        if scheme == "file":
            body = rest.replace("\\", "/")
            host, rest = re.fullmatch(r"(?:///?([^/?#]*))?(.*)", body, re.S).groups() if body.startswith("//") and not body.startswith("///") else ("", body.lstrip("/") if body.startswith("/") else body)
            return _tail(replace(url, host=host_of(host, True) if host and host.lower() != "localhost" else ""), (rest or "").lstrip("/"), ())
        if url.special:
            if base and base.scheme == scheme and not slash.match(rest):
                return _relative(rest, base)
            return _after_authority(url, rest.lstrip("/\\"))
        if rest.startswith("//"):
            return _after_authority(url, rest[2:])
        if rest.startswith("/"):
            return _tail(url, rest[1:], ())
        rest, mark, fragment = rest.partition("#")
        path, q, query = rest.partition("?")
        return replace(url, path=escape(path, ""), query=escape(query, QUERY) if q else None, fragment=escape(fragment, FRAGMENT) if mark else None)
    if base is None:
        return None
    if isinstance(base.path, str):
        return replace(base, fragment=escape(text[1:], FRAGMENT)) if text.startswith("#") else None
    return _relative(text, base)


def _relative(text: str, base: Url) -> Url | None:
    base = replace(base, fragment=None)
    first = r"[/\\]" if base.special else "/"
    if re.match(first * 2, text):
        return _after_authority(Url(base.scheme), text.lstrip("/\\") if base.special else text[2:])
    if re.match(first, text):
        return _tail(base, text[1:], ())
    if not text or text[0] in "?#":
        plain, mark, fragment = text.partition("#")
        query = escape(plain[1:], SPECIAL_QUERY if base.special else QUERY) if plain else base.query
        return replace(base, query=query, fragment=escape(fragment, FRAGMENT) if mark else None)
    return _tail(base, text, base.path[:-1])


def resolve(url: str | None, base: str) -> str | None:
    """An absolute URL as a browser writes it; None for an empty one, inline data, and what can't be read."""
    url = (url or "").strip(_SPACE)
    if not url or url.startswith("data:"):
        return None
    out = parse(url, parse(base))
    return None if out is None else str(out)


#: Rows that are Python objects at a time: a batch of Arrow may hold 10,000.
_ROWS = 64


@F.arrow_udf(T.ArrayType(T.StringType()))
def resolved(urls: pa.Array, at: pa.Array, bases: pa.Array) -> pa.Array:
    """Each row's URLs against the one of the row's bases that ``at`` says; a base is parsed once."""

    def row(some, places, known) -> list:
        parsed = [parse(b) if b else None for b in known]
        out: list = []
        for u, k in zip(some, places, strict=True):
            u = (u or "").strip(_SPACE)
            url = parse(u, parsed[k]) if u and not u.startswith("data:") else None
            out.append(None if url is None else str(url))
        return out

    def some(i: int) -> pa.Array:
        return pa.array([row(*r) for r in zip(*(c.slice(i, _ROWS).to_pylist() for c in (urls, at, bases)), strict=True)], pa.list_(pa.string()))

    return pa.concat_arrays([some(i) for i in range(0, max(len(urls), 1), _ROWS)])
