"""Passwords and session tokens (SCL6, FLT12): scrypt with a salt per password, tokens of which only a digest is stored.

Hashing is slow by purpose and needs Python; it runs over Arrow batches, one password per row.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import col

# The cost of a hash, and the shortest key of the site.
COST, BLOCKS, LANES, SALT_BYTES, DIGEST_BYTES, SITE_KEY_CHARS = 2**14, 8, 1, 16, 32, 32


def _scrypt(password: str, salt: bytes, n: int, r: int, p: int, size: int) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, n=n, r=r, p=p, dklen=size)


def hashed(password: str) -> str:
    """scrypt$n$r$p$salt$digest."""
    salt = secrets.token_bytes(SALT_BYTES)
    return "$".join(["scrypt", str(COST), str(BLOCKS), str(LANES), salt.hex(), _scrypt(password, salt, COST, BLOCKS, LANES, DIGEST_BYTES).hex()])


def matches(password: str | None, stored: str | None) -> bool:
    """False for a wrong password, a missing one and a hash of another form."""
    kind, *rest = (stored or "").split("$")
    if password is None or kind != "scrypt" or len(rest) != 5:
        return False
    try:
        n, r, p = map(int, rest[:3])
        digest = bytes.fromhex(rest[4])
        return hmac.compare_digest(_scrypt(password, bytes.fromhex(rest[3]), n, r, p, len(digest)), digest)
    except ValueError:
        return False


@F.pandas_udf(T.StringType())
def password_hash(password: pd.Series) -> pd.Series:
    return password.map(hashed, na_action="ignore")


password_hash = password_hash.asNondeterministic()


@F.pandas_udf(T.BooleanType())
def password_matches(password: pd.Series, stored: pd.Series) -> pd.Series:
    return pd.Series([matches(p, s) for p, s in zip(password, stored)])


def new_token() -> str:
    return secrets.token_urlsafe(32)


def token_hash(token: Column | str) -> Column:
    """What is stored of a token."""
    return F.sha2(col(token), 256)


def site_key_ok(key: Column | str, least: int = SITE_KEY_CHARS) -> Column:
    """FLT12: null where no key is set, else whether it is long enough."""
    return F.when(F.coalesce(col(key), F.lit("")) != "", F.length(col(key)) >= least)
