"""Tenant keys and HMAC without UDFs: the driver derives the pads, SQL does the hashing."""

from __future__ import annotations

import hashlib
import hmac
import re

from .dialect import Dialect

#: Fixed forms of names.
TENANT, NAMESPACE, LABEL = r"^[a-zA-Z0-9][a-zA-Z0-9_.-]{0,63}$", r"^[a-z0-9_]{1,64}$", r"^[a-z0-9_-]{1,16}$"


def derive(root: bytes, salt: bytes, info: str) -> bytes:
    """HKDF-SHA256, one block of 32 bytes.  Roots of under 32 bytes are refused."""
    if len(root) < 32:
        raise ValueError("a root key has 32 bytes at least")
    return hmac.new(hmac.new(salt, root, hashlib.sha256).digest(), info.encode() + b"\x01", hashlib.sha256).digest()


def tenant_key(root: bytes, salt: bytes, tenant: str, purpose: str = "tenant") -> bytes:
    if not re.match(TENANT, tenant):
        raise ValueError(f"not a tenant name: {tenant!r}")
    return derive(root, salt, f"cloakwork/{purpose}/{tenant}")


def hmac_hex(d: Dialect, key: bytes, message: str) -> str:
    """HMAC-SHA256 of a string expression in UTF-8, as lowercase hex."""
    block = key.ljust(64, b"\x00")
    inner, outer = bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()
    if d.spark:
        return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), cast({message} as binary)), 256))), 256)"
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer block of HMAC-SHA256 under a key."""
    block = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def hmac_under(message: str, inner: str, outer: str) -> str:
    """HMAC-SHA256 as lowercase hex where the pads are columns: keys stand in a joined row, not in the plan's text."""
    return f"sha2(concat({outer}, unhex(sha2(concat({inner}, cast({message} as binary)), 256))), 256)"


class Keyring:
    """Keys of tenants from one root: for pseudonyms, for token identities of an epoch, for token data of a version."""

    def __init__(self, root: bytes, salt: bytes, epoch: str = "e1", version: str = "v1"):
        for label in (epoch, version):
            if not re.match(LABEL, label):
                raise ValueError(f"not a label: {label!r}")
        self.root, self.salt, self.epoch, self.version = root, salt, epoch, version
        derive(root, salt, "check")

    def frame(self, spark, tenants: list[str]):
        """A row of key columns for each tenant; names that aren't tenants' are refused."""
        rows = []
        for t in sorted(set(tenants)):
            own, identity, data = (tenant_key(self.root, self.salt, t, p) for p in ("tenant", f"token-identity/{self.epoch}", f"token-data/{self.version}"))
            rows.append((t, *map(bytearray, (*pads(own), *pads(identity), data))))
        return spark.createDataFrame(rows, "tenant string, own_in binary, own_out binary, id_in binary, id_out binary, data_key binary")
