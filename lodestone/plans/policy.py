"""Governance and admission policies: parsing, checks, keys, identity. Driver only."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import re
from dataclasses import asdict, dataclass, field, fields
from datetime import timedelta

from ..functions.columns import ACCOUNT, OPAQUE_NAME

# Our own domain strings, versions and limits.
KEY_SALT = b"lodestone/keys/v1\x00"
DOMAIN = "lodestone/domain/v1"
PSEUDONYM = "pseudonym/v1"
RANK = "cohort-rank/v1"
ACTIONS = ("omit", "replace", "hash", "pseudonymize")
TARGETS = ("attribute", "metadata", "body")
LEAST_SECRET = 32
DIGEST_BYTES = 32
DEFAULT_RETAINED = 64 << 20


class PolicyError(ValueError):
    """A policy that must not be used; ``code`` is stable."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code


@dataclass(frozen=True)
class Rule:
    id: str
    service: str
    resource: str
    kind: str
    path: str
    action: str
    replacement: str = ""
    key_id: str = ""
    scope: str = ""
    algorithm: str = ""
    content_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Cohort:
    resource: str
    key_id: str
    key_paths: tuple[str, ...]
    limit: int
    scope: str = ""
    algorithm: str = RANK
    max_retained_bytes: int = 0
    predicates: tuple[tuple[str, object], ...] = ()


def domain(parts: list[str]) -> bytes:
    """Fields under a domain string, each after a NUL with its length."""
    if any("\x00" in p for p in parts):
        raise PolicyError("invalid_field", "a field holds a NUL")
    return DOMAIN.encode() + b"".join(b"\x00%d:%s" % (len(p.encode()), p.encode()) for p in parts)


def derive(secret: bytes, key_id: str, parts: list[str]) -> bytes:
    """HKDF-SHA256: 32 bytes bound to all the fields."""
    if len(secret) < LEAST_SECRET:
        raise PolicyError("short_secret", f"at least {LEAST_SECRET} bytes are needed")
    seed = hmac.new(KEY_SALT + key_id.encode(), secret, hashlib.sha256).digest()
    return hmac.new(seed, domain(parts) + b"\x01", hashlib.sha256).digest()


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer 64-byte pads of an HMAC key."""
    full = key.ljust(64, b"\x00")
    return bytes(b ^ 0x36 for b in full), bytes(b ^ 0x5C for b in full)


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass
class Profile:
    """A named set of rules and cohorts with its secret, which is never shown."""

    name: str
    rules: tuple[Rule, ...] = ()
    cohorts: tuple[Cohort, ...] = ()
    secret: bytes = field(default=b"", repr=False)

    def __post_init__(self) -> None:
        self.rules = tuple(sorted(self.rules, key=lambda r: (r.service, r.resource, r.kind, r.path, r.id)))
        self.cohorts = tuple(sorted(self.cohorts, key=lambda c: c.resource))
        self.check()

    def check(self) -> None:
        if not re.fullmatch(OPAQUE_NAME[1:-1], self.name):
            raise PolicyError("invalid_name", self.name)
        seen, ids = set(), set()
        for r in self.rules:
            if not re.fullmatch(OPAQUE_NAME[1:-1], r.id) or r.id in ids:
                raise PolicyError("invalid_rule_id", r.id)
            if r.action not in ACTIONS or r.kind not in TARGETS:
                raise PolicyError("unsupported_rule", f"{r.action} on {r.kind}")
            if r.kind == "body" and not r.content_types:
                raise PolicyError("missing_content_types", r.id)
            if r.action == "pseudonymize" and (not r.key_id or r.algorithm not in ("", PSEUDONYM)):
                raise PolicyError("invalid_key", r.id)
            if (target := (r.service, r.resource, r.kind, r.path)) in seen:
                raise PolicyError("repeated_target", r.id)
            seen.add(target)
            ids.add(r.id)
        for c in self.cohorts:
            if not c.key_id or c.limit <= 0 or c.algorithm != RANK or not c.key_paths or 0 < c.max_retained_bytes < DIGEST_BYTES:
                raise PolicyError("invalid_cohort", c.resource)
        if len({c.resource for c in self.cohorts}) < len(self.cohorts):
            raise PolicyError("repeated_cohort")
        if (self.cohorts or any(r.action == "pseudonymize" for r in self.rules)) and len(self.secret) < LEAST_SECRET:
            raise PolicyError("short_secret", f"at least {LEAST_SECRET} bytes are needed")

    def identity(self) -> str:
        """A digest of all but the secret."""
        return "sha256:" + digest({"name": self.name, "rules": [asdict(r) for r in self.rules], "cohorts": [asdict(c) for c in self.cohorts]})

    def rule_key(self, rule: Rule) -> bytes:
        return derive(self.secret, rule.key_id, [PSEUDONYM, rule.key_id, rule.scope, self.name, rule.service, rule.resource, rule.id, rule.kind, rule.path])

    def rank_key(self, cohort: Cohort) -> bytes:
        return derive(self.secret, cohort.key_id, [RANK, cohort.key_id, cohort.scope, self.name, cohort.resource])


def _strict(kind: type, data: dict) -> dict:
    unknown = set(data) - {f.name for f in fields(kind)}
    if unknown:
        raise PolicyError("unknown_key", ", ".join(sorted(unknown)))
    return {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}


def load_profiles(text: str, selected: str | None, secrets: dict[str, str]) -> Profile | None:
    """The selected profile of a YAML document; required once there are any."""
    import yaml

    data = yaml.safe_load(text) or {}
    if set(data) - {"profiles"}:
        raise PolicyError("unknown_key", ", ".join(sorted(set(data) - {"profiles"})))
    found = data.get("profiles") or {}
    if not found and not selected:
        return None
    if selected is None:
        raise PolicyError("profile_required")
    if selected not in found:
        raise PolicyError("unknown_profile", selected)
    own = found[selected] or {}
    if set(own) - {"rules", "cohorts"}:
        raise PolicyError("unknown_key", ", ".join(sorted(set(own) - {"rules", "cohorts"})))
    try:
        secret = base64.b64decode(secrets.get(selected, ""), validate=True)
    except ValueError as e:
        raise PolicyError("invalid_secret") from e
    cohorts = []
    for c in own.get("cohorts") or []:
        c = dict(c)
        c["predicates"] = [(p["attribute"], p["value"]) for p in c.get("predicates") or []]
        cohorts.append(Cohort(**_strict(Cohort, c)))
    return Profile(selected, tuple(Rule(**_strict(Rule, r)) for r in own.get("rules") or []), tuple(cohorts), secret)


_UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def duration(text: str) -> timedelta:
    """A duration such as 1h30m or 250ms."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise PolicyError("invalid_duration", text)
    return timedelta(seconds=sum(float(a) * _UNITS[b] for a, b in parts))


@dataclass(frozen=True)
class Admission:
    """What a snapshot must meet to be let in."""

    schema_version: int = 1
    allowed_accounts: tuple[str, ...] = ()
    allowed_finding_codes: tuple[str, ...] = ()
    allowed_severities: tuple[str, ...] = ()
    max_age: str = ""
    producer_repository: str = ""
    producer_workflow: str = ""

    def __post_init__(self) -> None:
        if self.schema_version != 1:
            raise PolicyError("unsupported_schema", str(self.schema_version))
        if any(not re.fullmatch(ACCOUNT[1:-1], a) for a in self.allowed_accounts):
            raise PolicyError("invalid_account")
        if self.max_age:
            duration(self.max_age)

    def canonical(self) -> dict:
        return {k: sorted(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    def identity(self) -> str:
        return "sha256:" + digest(self.canonical())


def load_admission(text: str) -> Admission:
    import yaml

    return Admission(**_strict(Admission, yaml.safe_load(text) or {}))
