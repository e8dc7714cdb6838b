"""Hosts of URLs: names in one form, numbers in any base, and which host a link shows and which it leads to."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from urllib.parse import unquote

from lakesift.functions.encoded import compatible

_URL = re.compile(r"(?:https?:)?//(?:\[[0-9a-z:._%-]+\](?::\d+)?[^\s<>\"')]*|[^\s<>\"')\]]+)", re.IGNORECASE)
_PARTS = re.compile(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)", re.IGNORECASE)
_NUMBER = re.compile(r"(0[xX][0-9a-fA-F]+)|(0[0-7]+)|(0|[1-9][0-9]*)")
_DOTS = str.maketrans("。．｡", "...")


def split_url(url: str) -> tuple[str, str] | None:
    """(host, path) of a URL with an authority; None where it can't be one."""
    scheme, authority, path = _PARTS.match(url.strip()).groups()
    if not authority or re.search(r"[\x00-\x20\x7f]", url.strip()):
        return None
    place = authority.rpartition("@")[2]
    if place.startswith("["):
        host, bracket, port = place[1:].partition("]")
        host = unquote(host)
    else:
        host, colon, port = place.partition(":")
        bracket, port = "]", colon + port
        host = unquote(host)
    if not bracket or not host or not re.fullmatch(r"(?::\d*)?", port):
        return None
    return host.lower(), unquote(path or "")


def named(host: str) -> str:
    """A host in lower case and ASCII, without www. and closing dot."""
    plain = host.strip().lower().removesuffix(".").removeprefix("www.")
    if not plain.isascii():
        try:
            plain = compatible(plain).translate(_DOTS).encode("idna").decode().lower()
        except UnicodeError:
            pass
    return plain.removeprefix("www.").removesuffix(".")


def number(text: str) -> int | None:
    """A number in base 16, 8 or 10, as its prefix says."""
    m = _NUMBER.fullmatch(text)
    return None if m is None else int(m[1], 16) if m[1] else int(m[2], 8) if m[2] else int(m[3])


def is_address(host: str) -> bool:
    """IPv4 in one to four parts of any base, the last part filling what is left; IPv6, with a zone or without."""
    if ":" in host:
        try:
            return ipaddress.ip_address(host.partition("%")[0] if host.find("%") > 0 else host).version == 6
        except ValueError:
            return False
    parts = [number(p) for p in host.split(".")]
    if not 1 <= len(parts) <= 4 or None in parts:
        return False
    return all(p <= 255 for p in parts[:-1]) and parts[-1] < 256 ** (5 - len(parts))


def urls(line: str) -> Iterator[tuple[str, str]]:
    """(host in one form, path) of every URL of a line, also those without a scheme."""
    for m in dict.fromkeys(_URL.findall(line)):
        if (found := split_url(m)) and (host := named(found[0])):
            yield host, found[1]


def _unwrapped(label: str) -> str:
    """A label without angle brackets, emphasis and code marks around it, a few layers deep."""
    text = label.strip()
    for _ in range(4):
        was = text
        if len(text) > 2 and text[0] == "<" and text[-1] == ">":
            text = text[1:-1].strip()
        for mark in ("**", "__"):
            if len(text) > 4 and text.startswith(mark) and text.endswith(mark):
                text = text[2:-2].strip()
                break
        else:
            if len(text) > 2 and text[0] == text[-1] and text[0] in "*_" and text[0] not in (text[1], text[-2]):
                text = text[1:-1].strip()
        ticks = len(text) - len(text.lstrip("`"))
        if ticks and len(text) > 2 * ticks and text.endswith("`" * ticks):
            text = text[ticks:-ticks].strip()
        if text == was:
            break
    return text


def shown_host(label: str) -> str | None:
    """The host that a link's label shows, if it looks like one."""
    text = _unwrapped(label)
    if not text or " " in text:
        return None
    if "://" not in text:
        if text.startswith("//"):
            text = f"https:{text}"
        elif "." in text.translate(_DOTS):
            text = f"https://{text}"
        else:
            return None
    found = split_url(text)
    return named(found[0]) if found else None


def target_host(target: str) -> str | None:
    """The host that a link's target leads to, if it is a web address."""
    text = target.strip()
    if text.startswith("<"):
        text = text[1:].partition(">")[0].strip() if ">" in text else ""
    else:
        text = (text.split() or [""])[0]
    if text.startswith("//"):
        text = f"https:{text}"
    if not text.lower().startswith(("http://", "https://")):
        return None
    found = split_url(text)
    return named(found[0]) if found else None


_INLINE = re.compile(r"\[([^\]]+)\]\(([^)\n]+)\)")
_FULL = re.compile(r"\[([^\]]+)\][ \t]*\[([^\]]*)\]")
_SHORT = re.compile(r"\[([^\]]+)\]")
_DEFINITION = re.compile(r"\s{0,3}\[([^\]]+)\]:\s*(.*?)\s*")


def _is_image(line: str, start: int) -> bool:
    """Whether a bracket belongs to an image: an exclamation mark before it that isn't escaped."""
    before = line[:start]
    marks = before.removesuffix("!")
    return before != marks and (len(marks) - len(marks.rstrip("\\"))) % 2 == 0


def reference_id(text: str) -> str:
    return " ".join(text.lower().split())


def spoofed(line: str) -> bool:
    """Whether an inline link shows one host and leads to another."""
    for m in _INLINE.finditer(line):
        if not _is_image(line, m.start()) and (shown := shown_host(m[1])) and (real := target_host(m[2])) and shown != real:
            return True
    return False


def definition(line: str, following: str | None) -> tuple[str, str] | None:
    """(id, host) of a reference definition that leads to a web address, on this line or on the next."""
    m = _DEFINITION.fullmatch(line)
    if m is None or not (name := reference_id(m[1])):
        return None
    host = target_host(m[2]) or (target_host(following or "") if not m[2] else None)
    return (name, host) if host else None


def references(line: str) -> Iterator[tuple[str, str]]:
    """(id, host shown) of full, collapsed and shortcut references whose label looks like a host."""
    for m in _FULL.finditer(line):
        if not _is_image(line, m.start()) and (shown := shown_host(m[1])):
            yield reference_id(m[2] if m[2].strip() else m[1]), shown
    for m in _SHORT.finditer(line):
        if not _is_image(line, m.start()) and line[m.end() :].lstrip(" \t")[:1] not in ("(", "[", ":") and (shown := shown_host(m[1])):
            yield reference_id(m[1]), shown


def continued_reference(line: str, following: str | None) -> str | None:
    """A usage whose second bracket stands on the next line."""
    now, then = line.strip(), (following or "").strip()
    return f"{now} {then}" if "]" in now and then.startswith("[") and "]:" not in then else None
