"""Address predicates over the text form of IPv4 and IPv6 addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9a-f]{1,4}"
_V4 = rf"({_OCTET}\.){{3}}{_OCTET}"


def _v6_forms() -> str:
    forms = [rf"({_HEX}:){{7}}{_HEX}"]
    for left in range(0, 8):
        head = "" if left == 0 else rf"{_HEX}(:{_HEX}){{{left - 1}}}"
        room = 7 - left
        tail = rf"({_HEX}(:{_HEX}){{0,{room - 1}}})?" if room else ""
        forms.append(f"{head}::{tail}")
    forms.append(rf"::(ffff(:0{{1,4}})?:)?{_V4}")
    forms.append(rf"({_HEX}:){{6}}{_V4}")
    return "|".join(forms)


V4_PATTERN = f"^{_V4}$"
V6_PATTERN = f"^({_v6_forms()})(%.+)?$"
MAPPED = "(::ffff:)?"
GROUP_V4 = rf"(22[4-9]|23\d)(\.{_OCTET}){{3}}|255\.255\.255\.255"
LOCAL_V4 = rf"169\.254(\.{_OCTET}){{2}}"
GROUP_V6, LOCAL_V6 = "ff[0-9a-f]{2}:", "fe[89ab][0-9a-f]:"


def ip_family(ip: Column) -> Column:
    """'v4', 'v6' or null when the text is not an address."""
    return (F.when(ip.rlike(V4_PATTERN), F.lit("v4"))
            .when(F.lower(ip).rlike(V6_PATTERN), F.lit("v6")))


def _pattern(v4: str, v6: str) -> str:
    """One pattern for both families; the long IPv6 form is only tried behind the right prefix."""
    return f"(?i)^(?:{MAPPED}({v4})|(?={v6})({_v6_forms()})(%.+)?)$"


GROUP = _pattern(GROUP_V4, GROUP_V6)
LOCAL = _pattern(LOCAL_V4, LOCAL_V6)
GROUP_OR_LOCAL = _pattern(f"{GROUP_V4}|{LOCAL_V4}", f"{GROUP_V6}|{LOCAL_V6}")


def is_multicast_or_broadcast(ip: Column) -> Column:
    return ip.rlike(GROUP)


def is_link_local(ip: Column) -> Column:
    return ip.rlike(LOCAL)


def is_noise(drop_link_local: bool, src: str = "src_ip", dst: str = "dst_ip") -> Column:
    pattern = GROUP_OR_LOCAL if drop_link_local else GROUP
    noisy = lambda end: F.coalesce(F.col(end).rlike(pattern), F.lit(False))
    return noisy(src) | noisy(dst)
