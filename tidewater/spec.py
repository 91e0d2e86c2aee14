"""Entities as data: columns, keys, recency, owners and frozen vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

# Vocabularies of the data model.
CHANNEL = ("organic", "paid_search", "email", "social", "direct", "affiliate")
DEVICE = ("desktop", "mobile", "tablet")
ORDER_STATUS = ("pending", "confirmed", "shipped", "delivered", "cancelled", "returned")
PAYMENT_METHOD = ("card", "paypal", "bank_transfer", "gift_card")
PAYMENT_STATUS = ("authorized", "captured", "failed", "refunded", "chargeback")
EVENT_TYPE = ("page_view", "product_view", "add_to_cart", "begin_checkout", "purchase", "search")
TIER = ("bronze", "silver", "gold", "platinum")
SEGMENT = ("new", "active", "at_risk", "churned", "vip")
TICKET_STATUS = ("open", "pending", "resolved")
CONTACT_CHANNEL = ("email", "chat", "phone", "web_form")
PRIORITY = ("P1", "P2", "P3", "P4")
SENTIMENT = ("positive", "neutral", "negative")

#: Lineage columns that every captured row carries, and those that conformed rows keep.
LINEAGE = ("_ingested_at", "_ingest_run_id", "_source_system", "_source_file", "_record_hash", "_batch_seq")
KEPT_LINEAGE = ("_ingested_at", "_ingest_run_id", "_source_system", "_record_hash")
#: Columns that never enter the lake.
RESTRICTED = frozenset({"first_name", "last_name", "email", "phone"})
SOURCES = ("oltp", "files", "restapi", "vendor", "stream")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    minimum: float | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    source: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    recency: str
    drop: tuple[str, ...] = ()
    also_from: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


def _money(name: str) -> Field:
    return Field(name, "decimal(12,2)", minimum=0)


ENTITIES: dict[str, Entity] = {
    e.name: e
    for e in (
        Entity("customers", "oltp", ("customer_id",), (Field("customer_id"), Field("city"), Field("country"), Field("signup_date", "date"), Field("loyalty_tier", allowed=TIER), Field("segment", allowed=SEGMENT), Field("is_deleted", "boolean"), Field("updated_at", "timestamp")), "updated_at"),
        Entity("orders", "oltp", ("order_id",), (Field("order_id"), Field("customer_id"), Field("order_ts", "timestamp"), Field("order_date", "date"), Field("status", allowed=ORDER_STATUS), Field("channel", allowed=CHANNEL), Field("device_type", allowed=DEVICE), *map(_money, ("gross_amount", "discount_amount", "shipping_amount", "tax_amount", "total_amount"))), "order_ts"),
        Entity("order_items", "oltp", ("order_item_id",), (Field("order_item_id"), Field("order_id"), Field("line_number", "int", minimum=1), Field("product_id"), Field("quantity", "int", minimum=1), _money("unit_price"), _money("line_amount"), Field("order_ts", "timestamp")), "order_ts", drop=("order_ts",)),
        Entity("customer_change_log", "oltp", ("customer_id", "changed_at", "field"), (Field("customer_id"), Field("changed_at", "timestamp"), Field("field"), Field("old_value", nullable=True), Field("new_value", nullable=True)), "changed_at"),
        Entity("products", "files", ("product_id",), (Field("product_id"), Field("sku"), Field("product_name"), Field("category"), Field("subcategory"), _money("unit_price"), _money("unit_cost"), Field("is_active", "boolean")), "_ingested_at"),
        Entity("web_events", "files", ("event_id",), (Field("event_id"), Field("session_id"), Field("customer_id", nullable=True), Field("event_ts", "timestamp"), Field("event_type", allowed=EVENT_TYPE), Field("product_id", nullable=True), Field("order_id", nullable=True), Field("channel", allowed=CHANNEL), Field("device_type", allowed=DEVICE)), "event_ts", also_from=("stream",)),
        Entity("support_tickets", "restapi", ("ticket_id",), (Field("ticket_id"), Field("customer_id"), Field("order_id", nullable=True), Field("created_ts", "timestamp"), Field("resolved_ts", "timestamp", nullable=True), Field("status", allowed=TICKET_STATUS), Field("channel", allowed=CONTACT_CHANNEL), Field("subject"), Field("body"), Field("intent"), Field("priority", allowed=PRIORITY), Field("sentiment", allowed=SENTIMENT)), "created_ts"),
        Entity("payments", "vendor", ("payment_id",), (Field("payment_id"), Field("order_id"), Field("attempt_number", "int", minimum=1), Field("payment_method", allowed=PAYMENT_METHOD), Field("status", allowed=PAYMENT_STATUS), _money("amount"), Field("processed_ts", "timestamp"), Field("failure_reason", nullable=True)), "processed_ts"),
    )
}


def check_owner(source: str, entity: str) -> None:
    """Only an entity's own source (or one it is also fed from) may write it."""
    spec = ENTITIES[entity]
    if source not in (spec.source, *spec.also_from):
        raise PermissionError(f"{entity} belongs to {spec.source}, not to {source}")


def check_names(source: str, entity: str) -> None:
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    if not (entity.isidentifier() and entity.islower()):
        raise ValueError(f"{entity!r} is no entity name")


def check_unrestricted(columns: list[str], restricted: frozenset[str] = RESTRICTED) -> None:
    bad = sorted(restricted & set(columns))
    if bad:
        raise PermissionError(f"restricted columns in the lake: {', '.join(bad)}")
