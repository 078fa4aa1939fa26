"""Driver guards for model endpoints."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

# Fixed value: the one public host that is allowed, and only with a key.
CLOUD_HOST = "api.openai.com"


def allowed(url: str, has_key: bool = False) -> bool:
    """Loopback and private addresses; the cloud host over HTTPS with a key."""
    parts = urlsplit(url)
    host = parts.hostname or ""
    if parts.scheme not in ("http", "https") or not host:
        return False
    if host == "localhost":
        return True
    if host == CLOUD_HOST:
        return parts.scheme == "https" and has_key
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return False
    return address.is_loopback or (address.is_private and address.version == 4 and not address.is_link_local and not address.is_unspecified)


def check_redirect(origin: str, target: str, has_key: bool = False) -> None:
    """A redirect must be allowed itself and must not change between private and cloud."""
    cloud = [urlsplit(u).hostname == CLOUD_HOST for u in (origin, target)]
    if not allowed(target, has_key) or cloud[0] != cloud[1]:
        raise PermissionError(f"redirect to {target} refused")
