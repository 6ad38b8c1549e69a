"""Adapters: how a service's resources are found, captured and linked."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bounds, cohort, govern
from .plans.policy import Profile, digest
from .sources import readers


@dataclass(frozen=True)
class Options:
    """What of a resource is captured; missing limits get their defaults."""

    resource: str
    key: tuple[str, ...]
    mode: str = "bounded"
    max_items: int = 1000
    include_data: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("bounded", "full") or self.max_items <= 0 or not self.key:
            raise ValueError(f"invalid options for {self.resource}")

    def definition(self, policy: str | None) -> str:
        return digest({"resource": self.resource, "key": self.key, "mode": self.mode, "max_items": self.max_items if self.mode == "bounded" else None, "policy": policy})


class Adapter(ABC):
    """One service. All but ``checks`` must be given."""

    service: str

    @abstractmethod
    def discover(self, spark: SparkSession) -> DataFrame:
        """(type, id, arn) of its resources."""

    @abstractmethod
    def capture(self, spark: SparkSession, options: Options, profile: Profile | None) -> DataFrame:
        """The governed rows of a resource."""

    @abstractmethod
    def dependencies(self, spark: SparkSession) -> DataFrame:
        """(from_service, from_type, from_id, to_service, to_type, to_id, to_arn, required)."""

    @abstractmethod
    def validate(self, spark: SparkSession, options: Options) -> list[tuple[str, str, str]]:
        """Findings (code, severity, resource) about a resource."""

    def truncated(self, spark: SparkSession, options: Options) -> bool:
        """Whether a bounded capture leaves rows out."""
        return False

    def checks(self) -> list[tuple[str, bool, bool]]:
        """Permission probes (name, ok, blocking), where the service has any."""
        return []


class Registry:
    """Adapters by their names, which are unique, in order."""

    def __init__(self, *adapters: Adapter):
        self._by_name: dict[str, Adapter] = {}
        for a in adapters:
            if a.service in self._by_name:
                raise ValueError(f"two adapters for {a.service}")
            self._by_name[a.service] = a

    def __iter__(self):
        return iter(self._by_name[n] for n in sorted(self._by_name))

    def __getitem__(self, service: str) -> Adapter:
        return self._by_name[service]


@dataclass
class TableAdapter(Adapter):
    """Parquet tables below a folder, as resources of one service."""

    folder: str
    tables: dict[str, tuple[str, ...]]
    links: list[tuple[str, str]] = field(default_factory=list)
    service: str = "tables"

    def _read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}.parquet")

    def discover(self, spark: SparkSession) -> DataFrame:
        rows = [("table", n, f"arn:aws:tables:local:000000000000:{n}") for n in sorted(self.tables)]
        return spark.createDataFrame(rows, "type string, id string, arn string")

    def capture(self, spark: SparkSession, options: Options, profile: Profile | None) -> DataFrame:
        if not options.include_data:
            readers.structure_only(True)
        rows = self._read(spark, options.resource)
        chosen = next((c for c in profile.cohorts if c.resource == options.resource), None) if profile else None
        if chosen:
            if options.mode != "full":
                raise ValueError("a cohort is taken from all rows; use the full mode")
            rows = cohort.select(rows, profile, chosen, F.concat_ws("\x00", *options.key)).drop("rank")
        elif options.mode == "bounded":
            rows, _ = bounds.page_limit(rows, list(options.key), options.max_items)
        return govern.govern_attributes(rows, profile, options.resource) if profile else rows

    def truncated(self, spark: SparkSession, options: Options) -> bool:
        if options.mode != "bounded":
            return False
        _, more = bounds.page_limit(self._read(spark, options.resource).select(*options.key), list(options.key), options.max_items)
        return more.first()["truncated"]

    def dependencies(self, spark: SparkSession) -> DataFrame:
        rows = [(self.service, "table", a, self.service, "table", b, f"arn:aws:tables:local:000000000000:{b}", True) for a, b in self.links]
        return spark.createDataFrame(rows, "from_service string, from_type string, from_id string, to_service string, to_type string, to_id string, to_arn string, required boolean")

    def validate(self, spark: SparkSession, options: Options) -> list[tuple[str, str, str]]:
        missing = [k for k in options.key if k not in self._read(spark, options.resource).columns]
        return [("KEY_MISSING", "error", options.resource)] if missing else []


def preflight(registry: Registry) -> list[tuple[str, str, bool, bool]]:
    """All probes; fails if a blocking one is not met."""
    rows = [(a.service, *c) for a in registry for c in a.checks()]
    if bad := [r for r in rows if r[3] and not r[2]]:
        raise PermissionError(", ".join(f"{s}: {n}" for s, n, _, _ in bad))
    return rows


#: Which data modes each kind of source has.
CAPABILITIES = [
    ("tables", "full", True),
    ("tables", "bounded", True),
    ("tables", "cohort", True),
    ("objects", "full", True),
    ("objects", "bounded", True),
    ("streams", "bounded", True),
    ("queues", "bounded", True),
    ("structures", "none", False),
]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "service string, mode string, has_data boolean")
