"""Encryption of stored columns with Spark's own AES, keys from passwords, and a registry of ciphers.

Every column of a sealed segment holds `aes_encrypt` of its text form under a random nonce (GCM: authenticated), so
columns can still be pruned; null stays null. Ciphers that Spark lacks are refused unless someone registers them.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import Code, CryptoError

#: Names of ciphers that the API knows; the first two are Spark's.
KNOWN = ("aes-256-gcm", "aes-256-cbc", "aria-256-gcm", "aria-256-cbc", "seed-cbc", "chacha20-poly1305", "none")
MOST_CIPHERS, ITERATIONS = 32, 200_000


@dataclass(frozen=True)
class Cipher:
    """Column functions (plain or sealed binary, key) -> binary."""

    name: str
    key_size: int
    seal: Callable[[SparkColumn, bytes], SparkColumn]
    open: Callable[[SparkColumn, bytes], SparkColumn]


def _mac(column: SparkColumn, key: bytes) -> SparkColumn:
    """HMAC-SHA-256 of a binary column, under a key of its own that comes from the cipher's."""
    block = hmac.digest(key, b"granary mac key", "sha256").ljust(64, b"\0")
    digest = lambda pad, data: F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ pad for x in block)), data), 256))
    return digest(0x5C, digest(0x36, column))


def _gcm() -> Cipher:
    return Cipher(
        "aes-256-gcm",
        32,
        lambda column, key: F.aes_encrypt(column, F.lit(key), F.lit("GCM")),
        lambda column, key: F.aes_decrypt(column, F.lit(key), F.lit("GCM")),
    )


def _cbc() -> Cipher:
    """CBC has no tag of its own: 32 bytes of MAC over what was encrypted stand before it, and are checked first."""

    def seal(column: SparkColumn, key: bytes) -> SparkColumn:
        made = F.aes_encrypt(column, F.lit(key), F.lit("CBC"))
        # the vector is random: it is made once, then the MAC is taken of that
        return F.element_at(F.transform(F.array(made), lambda x: F.concat(_mac(x, key), x)), 1)

    def open_(column: SparkColumn, key: bytes) -> SparkColumn:
        body = F.substring(column, 33, 1 << 30)
        right = F.substring(column, 1, 32) == _mac(body, key)
        fail = F.raise_error(F.lit("the sealed value was changed")).cast("binary")
        return F.when(column.isNull(), F.lit(None).cast("binary")).when(right, F.aes_decrypt(body, F.lit(key), F.lit("CBC"))).otherwise(fail)

    return Cipher("aes-256-cbc", 32, seal, open_)


_registry: dict[str, Cipher] = {c.name: c for c in (_gcm(), _cbc())}


def register_cipher(cipher: Cipher) -> None:
    if cipher.name in _registry:
        raise CryptoError(f"cipher {cipher.name} is registered", Code.CONSTRAINT)
    if len(_registry) >= MOST_CIPHERS:
        raise CryptoError("too many ciphers", Code.FULL)
    _registry[cipher.name] = cipher


def unregister_cipher(name: str) -> None:
    if _registry.pop(name, None) is None:
        raise CryptoError(f"no cipher {name}", Code.NOTFOUND)


def get_cipher(name: str) -> Cipher:
    try:
        return _registry[name.lower()]
    except KeyError:
        raise CryptoError(f"cipher {name} is not available", Code.NOTFOUND) from None


def list_ciphers() -> list[str]:
    return sorted(_registry)


def derive(password: str | bytes, salt: bytes, kdf: str = "pbkdf2", size: int = 32, iterations: int = ITERATIONS) -> bytes:
    """A key from a password: pbkdf2 (HMAC-SHA-256), scrypt, hkdf (for keys that are random already) or none."""
    raw = password.encode() if isinstance(password, str) else password
    if kdf == "pbkdf2":
        return hashlib.pbkdf2_hmac("sha256", raw, salt, iterations, size)
    if kdf == "scrypt":
        return hashlib.scrypt(raw, salt=salt, n=1 << 14, r=8, p=1, dklen=size)
    if kdf == "hkdf":
        seed, out, block = hmac.digest(salt, raw, "sha256"), b"", b""
        while len(out) < size:
            block = hmac.digest(seed, block + bytes([len(out) // 32 + 1]), "sha256")
            out += block
        return out[:size]
    if kdf == "none":
        if len(raw) != size:
            raise CryptoError(f"a raw key has {size} bytes", Code.MISUSE)
        return raw
    raise CryptoError(f"no key derivation {kdf}", Code.MISUSE)


def random_bytes(n: int) -> bytes:
    return os.urandom(n)


def verifier(key: bytes) -> str:
    """What tells a right key from a wrong one without telling the key."""
    return hmac.digest(key, b"granary key check", "sha256").hex()


def _text_form(name: str, kind: str) -> SparkColumn:
    column = F.col(f"`{name}`")
    if kind == "binary":
        return column
    if kind.startswith(("array", "map", "struct")):
        return F.encode(F.to_json(column), "UTF-8")
    return F.encode(column.cast("string"), "UTF-8")


def seal(frame: DataFrame, cipher: Cipher, key: bytes) -> DataFrame:
    return frame.select(*(cipher.seal(_text_form(n, t), key).alias(n) for n, t in frame.dtypes))


def unseal(frame: DataFrame, schema: list[tuple[str, str]], cipher: Cipher, key: bytes) -> DataFrame:
    """frame: binary columns; schema: (name, type) to restore."""
    out = []
    for name, kind in schema:
        plain = cipher.open(F.col(f"`{name}`"), key)
        if kind.startswith(("array", "map", "struct")):
            plain = F.from_json(F.decode(plain, "UTF-8"), kind)
        elif kind != "binary":
            plain = F.decode(plain, "UTF-8").cast(kind)
        out.append(plain.alias(name))
    return frame.select(*out)


def self_test(frame: DataFrame, cipher: Cipher) -> bool:
    """Whether one round trip over the frame gives its rows again."""
    key = random_bytes(cipher.key_size)
    back = unseal(seal(frame, cipher, key), frame.dtypes, cipher, key)
    return not back.exceptAll(frame).take(1) and not frame.exceptAll(back).take(1)
