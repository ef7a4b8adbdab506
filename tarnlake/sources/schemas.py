"""Declared schemas of the lake's tables. All columns are nullable; dates and times are text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

INT, STRING, DOUBLE, BOOLEAN = T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()


def column(name: str, kind: T.DataType, comment: str | None = None) -> T.StructField:
    return T.StructField(name, kind, True, {"comment": comment} if comment else {})


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    fmt: str = "parquet"
    partition_by: tuple[str, ...] = ()
    external: bool = False


EMPLOYEES = Table(
    "sample_db.employees",
    T.StructType(
        [
            column("id", INT),
            column("name", STRING),
            column("dept", STRING),
            column("salary", DOUBLE),
            column("hire_date", STRING),
        ]
    ),
    fmt="orc",
)

USER_PROFILES = Table(
    "hive_db.user_profiles",
    T.StructType(
        [
            column("user_id", INT, "Unique user ID"),
            column("username", STRING),
            column("gender", STRING, "M / F"),
            column("age", INT),
            column("city", STRING),
            column("province", STRING),
            column("register_date", STRING, "YYYY-MM-DD"),
            column("membership_level", STRING, "bronze / silver / gold / platinum"),
            column("total_spent", DOUBLE, "Cumulative GMV (CNY)"),
        ]
    ),
    external=True,
)

ORDERS = Table(
    "hive_db.orders",
    T.StructType(
        [
            column("order_id", STRING),
            column("user_id", INT),
            column("product_id", INT),
            column("quantity", INT),
            column("unit_price", DOUBLE),
            column("discount_amount", DOUBLE),
            column("total_amount", DOUBLE),
            column("status", STRING, "pending / shipped / completed / cancelled / refunded"),
            column("payment_method", STRING, "alipay / wechat / creditcard / banktransfer"),
            column("city", STRING),
            column("province", STRING),
            column("created_at", STRING),
            column("dt", STRING, "Order date YYYY-MM-DD"),
        ]
    ),
    partition_by=("dt",),
    external=True,
)

PRODUCTS = Table(
    "hive_db.products",
    T.StructType(
        [
            column("product_id", INT, "SKU ID"),
            column("name", STRING, "商品名称"),
            column("category_id", INT, "分类ID"),
            column("brand", STRING, "品牌"),
            column("price", DOUBLE, "定价"),
            column("cost", DOUBLE, "成本价"),
            column("stock", INT, "库存量"),
            column("rating", DOUBLE, "评分 0-5"),
            column("review_count", INT, "评价数"),
            column("is_active", BOOLEAN, "是否上架"),
            column("created_date", STRING, "上架日期"),
        ]
    ),
)

DIM_CATEGORY = Table(
    "hive_db.dim_category",
    T.StructType(
        [
            column("category_id", INT, "分类ID"),
            column("name", STRING, "分类名称"),
            column("parent_id", INT, "父分类ID（0为顶级）"),
            column("level", INT, "层级"),
            column("sort_order", INT, "排序"),
        ]
    ),
)

USER_BEHAVIOR = Table(
    "hive_db.user_behavior",
    T.StructType(
        [
            column("event_id", STRING, "事件ID"),
            column("user_id", INT, "用户ID"),
            column("product_id", INT, "商品ID"),
            column("event_type", STRING, "view/cart/wishlist/purchase"),
            column("session_id", STRING, "会话ID"),
            column("duration_sec", INT, "停留秒数"),
            column("source", STRING, "来源：search/recommend/ad/direct"),
            column("device", STRING, "设备：mobile/pc/tablet"),
            column("ts", STRING, "事件时间"),
            column("dt", STRING, "日期 YYYY-MM-DD"),
        ]
    ),
    partition_by=("dt",),
)

LAKE = (EMPLOYEES, USER_PROFILES, ORDERS, PRODUCTS, DIM_CATEGORY, USER_BEHAVIOR)

# Allowed values, for ``domain_audit``.
DOMAINS = {
    USER_PROFILES.name: {
        "gender": ["M", "F"],
        "membership_level": ["bronze", "silver", "gold", "platinum"],
    },
    ORDERS.name: {
        "status": ["pending", "shipped", "completed", "cancelled", "refunded"],
        "payment_method": ["alipay", "wechat", "creditcard", "banktransfer"],
    },
    USER_BEHAVIOR.name: {
        "event_type": ["view", "cart", "wishlist", "purchase"],
        "source": ["search", "recommend", "ad", "direct"],
        "device": ["mobile", "pc", "tablet"],
    },
}
