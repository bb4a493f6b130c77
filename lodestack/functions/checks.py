"""Checks of configuration values on the driver: front doors, watch paths, the verification stamp."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

#: Names that never lead to a public host; fixed values (RFC 2606 and 6761).
RESERVED_TLDS = ("example", "invalid", "localhost", "test")
RESERVED_NAMES = ("example.com", "example.net", "example.org")


def reserved_host(host: str) -> bool:
    h = host.lower().rstrip(".")
    return h.split(".")[-1] in RESERVED_TLDS or any(h == n or h.endswith("." + n) for n in RESERVED_NAMES)


def ip_literal(host: str) -> bool:
    """Dotted, bracketed, decimal, octal or hexadecimal addresses."""
    bare = host.strip("[]")
    try:
        ipaddress.ip_address(bare)
        return True
    except ValueError:
        return bool(re.fullmatch(r"(0x[0-9a-f]+|\d+)(\.(0x[0-9a-f]+|\d+)){0,3}", bare.lower()))


def front_door_fault(url: str | None, instantiated: bool = True) -> str | None:
    """What is wrong with a corpus's public address; None if nothing is. An uninstantiated template may keep its markers."""
    if url is None or not url.strip():
        return "is not set"
    if "{{" in url:
        return "still has a template marker" if instantiated else None
    parts = urlsplit(url.strip())
    if parts.scheme not in {"http", "https"}:
        return "is not a URL"
    if not parts.hostname:
        return "has no host"
    if ip_literal(parts.hostname):
        return "is an address, not a name"
    if reserved_host(parts.hostname):
        return "is a reserved name"
    return None


def watch_fault(watch: object, fmt: str) -> str | None:
    """Why a watch declaration is refused; None if it is fine. Only JSON sources can be watched."""
    if fmt not in {"json", "geojson"}:
        return "only JSON sources can be watched"
    if not isinstance(watch, list) or not watch:
        return "must be a list of paths that is not empty"
    for path in watch:
        if not isinstance(path, str) or not path.strip():
            return "a path must be text"
        p = path.strip()
        if p.count("[]") > 1:
            return f"{p}: only one projection is allowed"
        if re.search(r"\[(?!\])|(?<!\[)\]", p) or any(not s.removesuffix("[]") for s in p.split(".")):
            return f"{p}: not a dotted path"
    return None


def stamp(text: str, by: str, date: str, attest: bool) -> str:
    """Sets last_verified and verified_by in a document's frontmatter; each line must be there exactly once."""
    if not by or not attest:
        raise ValueError("a verification names its author and is attested")
    for key, value in (("last_verified", date), ("verified_by", by)):
        text, n = re.subn(rf"(?m)^{key}:.*$", f"{key}: {value}", text)
        if n != 1:
            raise ValueError(f"{key} occurs {n} times")
    return text
