"""IOC / keyword patterns scanned over printable strings.

Fixed values: the 77 named patterns of the string extractor, in the order
they are declared, with the reference's literal spellings kept (the e-mail
entry repeats the MAC pattern, the registry entry spells KHEY_/KHLM, ".click"
has an unescaped dot, "base64string" ends in "9+/"). The only change is in
the url character class, where ``[`` and ``-`` are escaped so Java and RE2
parse it the way Python's ``re`` does. ``(?i)`` marks the case-insensitive
entries. ``FIXED_PATTERNS`` holds the intended spellings (``fixed=True``).
"""

from __future__ import annotations

IOC_PATTERNS: list[tuple[str, str]] = [
    ("url", r"\b(?:http|https|ftp):\/\/[a-zA-Z0-9\-._~:?#\[\]@!$&'()*+,;=]+"),
    ("ipv4_addr", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("ipv6_addr", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b|\b(?:[A-Fa-f0-9]{1,4}:){1,7}:\b|\b:[A-Fa-f0-9]{1,4}(?::[A-Fa-f0-9]{1,4}){1,6}\b"),
    ("mac_addr", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b"),
    ("email_addr", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b"),
    ("btc_wallet", r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("file_path", r"\bC:/"),
    ("dos_msg", r"!This program "),
    ("registry_key", r"\b(?:KHEY_|KHLM|HKCU)"),
    ("/dev/", r"/dev/"),
    ("/proc/", r"/proc/"),
    ("/bin/", r"/bin/"),
    ("/usr/", r"/usr/"),
    ("/tmp/", r"/tmp/"),
    ("/URI", r"/URI"),
    ("/FlateDecode", r"/FlateDecode"),
    ("/EmbeddedFile", r"/EmbeddedFile"),
    ("html", r"(?i)html"),
    ("javascript", r"(?i)javascript"),
    ("<script", r"(?i)<script"),
    (".click(", r"(?i).click"),
    ("onlick", r"(?i)onclick"),
    ("powershell", r"(?i)powershell"),
    ("Invoke-Expression", r"Invoke-Expression"),
    ("Invoke-Command", r"Invoke-Command"),
    ("Start-process", r"Start-process"),
    ("get", r"(?i)GET /"),
    ("post", r"(?i)POST /"),
    ("http", r"(?i)HTTP/"),
    ("http://", r"(?i)http://"),
    ("https://", r"(?i)https://"),
    ("ftp", r"(?i)ftp:"),
    ("useragent", r"(?i)User-Agent"),
    ("cookie", r"(?i)cookie"),
    ("internet", r"(?i)internet"),
    ("download", r"(?i)download"),
    ("connect", r"(?i)connect"),
    ("base64", r"(?i)base64"),
    ("base64string", r"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("crypt", r"crypt"),
    ("encode", r"(?i)encode"),
    ("decode", r"(?i)decode"),
    ("cache", r"(?i)cache"),
    ("certificate", r"(?i)certificate"),
    ("clipboard", r"(?i)clipboard"),
    ("command", r"(?i)command"),
    ("create", r"(?i)create"),
    ("debug", r"(?i)debug"),
    ("delete", r"(?i)delete"),
    ("desktop", r"(?i)desktop"),
    ("directory", r"(?i)directory"),
    ("disk", r"(?i)disk"),
    ("environment", r"(?i)environment"),
    ("enum", r"(?i)enum"),
    ("exit", r"(?i)exit"),
    ("file", r"(?i)file"),
    ("hostname", r"(?i)hostname"),
    ("install", r"(?i)install"),
    ("hidden", r"(?i)hidden"),
    ("keyboard", r"(?i)keyboard"),
    ("memory", r"(?i)memory"),
    ("module", r"(?i)module"),
    ("mutex", r"(?i)mutex"),
    ("password", r"(?i)password"),
    ("privilege", r"(?i)privilege"),
    ("process", r"(?i)process"),
    ("remote", r"(?i)remote"),
    ("resource", r"(?i)resource"),
    ("security", r"(?i)security"),
    ("service", r"(?i)service"),
    ("shell", r"(?i)shell"),
    ("snapshot", r"(?i)snapshot"),
    ("system", r"(?i)system"),
    ("thread", r"(?i)thread"),
    ("token", r"(?i)token"),
    ("wallet", r"(?i)wallet"),
    ("window", r"(?i)window"),
]

# Intended spellings for the entries the reference mistypes (``fixed=True``).
FIXED_PATTERNS: dict[str, str] = {
    "email_addr": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "registry_key": r"\b(?:HKEY_|HKLM|HKCU)",
    ".click(": r"(?i)\.click\(",
    "base64string": r"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789\+/",
}

# fixed value: the shortest printable run
MIN_STRING = 5


def patterns(fixed: bool = False) -> list[tuple[str, str]]:
    """(name, pattern) in name-sorted order (the vector slot order)."""
    pats = [(n, FIXED_PATTERNS.get(n, p) if fixed else p) for n, p in IOC_PATTERNS]
    return sorted(pats, key=lambda x: x[0])

# Literals one of which every match of these patterns contains (the other patterns are literals, or have none).
REQUIRED_LITERALS: dict[str, tuple[str, ...]] = {
    "url": ("http://", "https://", "ftp://"),
    "file_path": ("C:/",),
    "registry_key": ("KHEY_", "KHLM", "HKEY_", "HKLM", "HKCU"),
    ".click(": ("click",),
    "base64string": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz012345678",),
}
NO_LITERAL = {"ipv4_addr", "ipv6_addr", "mac_addr", "email_addr", "btc_wallet"}
_META = set(".^$*+?{}[]()|\\")


def required_literals(name: str, pattern: str) -> tuple[tuple[str, ...], bool]:
    """Literals of which a match contains one at least, and whether such a literal is a match by itself; none: ``((), False)``."""
    if name in NO_LITERAL:
        return (), False
    if name in REQUIRED_LITERALS:
        return REQUIRED_LITERALS[name], False
    body = pattern.removeprefix("(?i)")
    return ((body,), True) if not any(c in _META for c in body) else ((), False)
