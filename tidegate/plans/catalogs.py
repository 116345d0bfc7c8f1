"""Catalogs: which one a table is bound to, its session settings, and the table's name in it.

glue and rest catalogs hold Iceberg tables, which are written through them; unity catalogs hold Delta
tables, which are registered after they are written to their path. Needs the connectors' packages.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .config import Catalog, Config, ConfigError, Entity

#: The connectors' published names of classes.
ICEBERG, GLUE, S3_IO, UNITY = "org.apache.iceberg.spark.SparkCatalog", "org.apache.iceberg.aws.glue.GlueCatalog", "org.apache.iceberg.aws.s3.S3FileIO", "io.unitycatalog.spark.UCSingleCatalog"


@dataclass(frozen=True)
class Binding:
    """table: its name in the catalog; settings: of the session; namespace: that is made first, if any."""

    table: str
    settings: dict[str, str] = field(default_factory=dict)
    namespace: str | None = None


def _quoted(*parts: str) -> str:
    return ".".join(f"`{p}`" for part in parts for p in part.split("."))


def _settings(config: Config, c: Catalog) -> dict[str, str]:
    out = {"": ICEBERG}
    if c.warehouse_storage:
        from .inputs import located

        out["warehouse"] = located(config, c.warehouse_prefix or "", c.warehouse_storage).rstrip("/")
    if c.type == "glue":
        out |= {"catalog-impl": GLUE, "io-impl": S3_IO, "client.region": c.region}
    elif c.type == "unity":
        out = {"": UNITY, "uri": c.host, "token": c.token}
    else:
        kind, _, secret = (c.credential or "").partition(":")
        out |= {"type": "rest", "uri": c.uri, "warehouse": c.warehouse or out.get("warehouse")}
        out |= {"token": secret} if kind == "token" else {"credential": secret} if kind == "client_credentials" else {}
        out |= {"oauth2-server-uri": c.oauth2_server_uri, "scope": c.scope}
    return {f"spark.sql.catalog.{c.name}" + (f".{k}" if k else ""): v for k, v in out.items() if v}


def chosen(config: Config, e: Entity) -> Catalog | None:
    """The catalog of the entity's table, checked; None if it has none."""
    a = e.sink.accepted
    for kind, own in (("iceberg", a.iceberg), ("delta", a.delta)):
        if own is not None and a.format != kind:
            raise ConfigError(f"sink.accepted.{kind} is only supported for sink.accepted.format={kind}")
    own = a.iceberg if a.format == "iceberg" else a.delta
    if own is None:
        return None
    name, what = own.catalog or config.catalogs.default, f"sink.accepted.{a.format}.catalog"
    if not name:
        raise ConfigError(f"{what} is required (or set catalogs.default)")
    found = next((c for c in config.catalogs.definitions if c.name == name), None)
    if found is None:
        raise ConfigError(f"{what} references unknown catalog {name}")
    if (found.type == "unity") != (a.format == "delta"):
        raise ConfigError(f"{what}={name} has type={found.type}, which does not hold {a.format} tables")
    types = {s.name: s.type for s in config.storages.definitions}
    at = types.get(a.storage or config.storages.default or "", "local")
    allowed = ("s3", "gcs", "adls") if a.format == "delta" else ("s3", "gcs")
    if at not in allowed:
        raise ConfigError(f"{what}={name} requires sink.accepted storage of type {' or '.join(allowed)} (got {at})")
    return found


def binding(config: Config, e: Entity) -> Binding | None:
    c, a = chosen(config, e), e.sink.accepted
    if c is None:
        return None
    if c.type == "unity":
        schema = a.delta.schema or c.schema
        return Binding(_quoted(c.name, schema, a.delta.table or e.name), _settings(config, c), _quoted(c.name, schema) if c.create_schema_if_missing else None)
    namespace = a.iceberg.namespace or c.database or e.domain or "default"
    return Binding(_quoted(c.name, namespace, a.iceberg.table or e.name), _settings(config, c), _quoted(c.name, namespace) if c.type == "rest" or c.create_database_if_missing else None)


def attach(spark: SparkSession, bound: Binding) -> None:
    """Makes the catalog known to the session."""
    for key, value in bound.settings.items():
        spark.conf.set(key, value)
    if bound.namespace:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {bound.namespace}")


def register(spark: SparkSession, table: str, kind: str, path: str) -> None:
    """A table that was written to its path; ValueError if the name stands for another place."""
    if spark.catalog.tableExists(table.replace("`", "")):
        at = spark.sql(f"DESCRIBE DETAIL {table}").first()["location"] if kind == "delta" else None
        if at is not None and at.rstrip("/") != path.rstrip("/"):
            raise ValueError(f"{table} is a table at another place: {at}")
        return
    spark.sql(f"CREATE TABLE {table} USING {kind} LOCATION '{path}'")
