"""Static dimensions: event taxonomy, industry groups, statuses, scoring constants, display labels.

Everything here is small and fixed; a deployment may replace any of it by passing its own registry file
(`load_events`, `load_industries`) or label table. As DataFrames they are the broadcast side of every lookup.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Major code, label, then (sub-category, label, direction baseline, expected fields).
EVENTS = (
    ("A", "财报主事件", (
        ("earnings_q1", "一季报", 0.0, ("revenue", "revenue_yoy_pct", "net_profit", "net_profit_yoy_pct", "gross_margin", "net_margin", "eps", "roe", "operating_cashflow")),
        ("earnings_h1", "半年报", 0.0, ("revenue", "revenue_yoy_pct", "net_profit", "net_profit_yoy_pct", "gross_margin", "net_margin", "eps", "roe", "operating_cashflow")),
        ("earnings_q3", "三季报", 0.0, ("revenue", "revenue_yoy_pct", "net_profit", "net_profit_yoy_pct", "gross_margin", "net_margin", "eps", "roe", "operating_cashflow")),
        ("earnings_annual", "年报", 0.0, ("revenue", "revenue_yoy_pct", "net_profit", "net_profit_yoy_pct", "gross_margin", "net_margin", "eps", "roe", "operating_cashflow", "dividend_plan", "audit_opinion")),
    )),
    ("B", "财报前置事件", (
        ("forecast_performance", "业绩预告", 0.0, ("forecast_type", "forecast_net_profit_min", "forecast_net_profit_max", "forecast_yoy_change_pct", "previous_net_profit", "reason_summary")),
        ("forecast_express", "业绩快报", 0.0, ("revenue", "revenue_yoy_pct", "net_profit", "net_profit_yoy_pct", "total_assets", "net_assets")),
        ("forecast_revision", "业绩修正", 0.0, ("original_forecast", "revised_forecast", "revision_amount", "revision_pct", "revision_reason")),
    )),
    ("C", "股权变动事件", (
        ("equity_increase", "增持", 0.7, ("shareholder_name", "shareholder_type", "increase_amount", "increase_ratio_pct", "price_range", "increase_reason", "planned_continue")),
        ("equity_decrease", "减持", -0.7, ("shareholder_name", "shareholder_type", "decrease_amount", "decrease_ratio_pct", "price_range", "decrease_reason", "is_completed")),
        ("buyback", "回购", 0.8, ("buyback_amount_max", "buyback_ratio_pct", "buyback_price_max", "buyback_purpose", "funding_source", "buyback_period")),
        ("lockup_expiry", "解禁", -0.5, ("unlock_shares", "unlock_ratio_pct", "unlock_market_value", "unlock_date", "shareholder_list")),
        ("equity_incentive", "股权激励", 0.5, ("incentive_shares", "incentive_ratio_pct", "grant_price", "performance_targets", "recipient_count", "vesting_schedule")),
    )),
    ("D", "资本运作事件", (
        ("private_placement", "定增", 0.1, ("placement_amount", "placement_shares", "placement_price", "placement_purpose", "subscribers", "lockup_period", "approval_status")),
        ("merger_acquisition", "并购重组", 0.3, ("target_name", "transaction_amount", "payment_method", "target_industry", "target_revenue", "target_net_profit", "deal_status", "performance_commitment")),
        ("asset_sale", "资产出售", 0.2, ("asset_name", "sale_amount", "book_value", "gain_loss_amount", "buyer", "sale_reason")),
        ("convertible_bond", "可转债/发债", 0.1, ("bond_amount", "bond_term", "coupon_rate", "conversion_price", "use_of_proceeds", "credit_rating")),
    )),
    ("E", "经营业务事件", (
        ("major_contract", "重大合同", 0.6, ("contract_amount", "counterparty", "contract_type", "contract_period", "product_service", "is_framework_agreement")),
        ("bid_win", "中标", 0.6, ("project_name", "bid_amount", "project_owner", "project_period", "bid_rank")),
        ("product_approval", "产品获批", 0.7, ("product_name", "approval_type", "regulatory_body", "indication", "market_size_estimate")),
        ("project_commissioning", "项目投产", 0.5, ("project_name", "capacity", "investment_amount", "expected_revenue_contribution", "product_type")),
        ("strategic_cooperation", "战略合作", 0.4, ("partner_name", "cooperation_scope", "cooperation_period", "partner_type", "exclusivity")),
    )),
    ("F", "风险事件", (
        ("litigation", "诉讼", -0.6, ("case_type", "involved_amount", "plaintiff_defendant", "case_status", "potential_loss_estimate", "court_level")),
        ("penalty", "处罚", -0.7, ("regulatory_body", "penalty_type", "penalty_amount", "violation_type", "rectification_deadline", "business_impact")),
        ("investigation", "立案调查", -0.9, ("investigation_body", "investigation_reason", "subjects_involved", "stage")),
        ("debt_default", "债务逾期", -0.9, ("default_amount", "default_ratio_pct", "creditor", "debt_type", "default_reason", "negotiation_status")),
        ("st_delisting_risk", "ST/退市风险", -0.95, ("risk_type", "trigger_condition", "deadline", "remediation_possible")),
    )),
    ("G", "治理与交易状态事件", (
        ("executive_change", "高管变动", 0.0, ("executive_name", "position", "change_type", "reason", "successor", "background")),
        ("controller_change", "实控人变更", 0.2, ("new_controller", "old_controller", "change_method", "transfer_ratio", "transfer_price", "new_controller_bg", "regulatory_approval_needed")),
        ("trading_halt_resume", "停复牌", 0.0, ("halt_reason", "halt_date", "resume_date", "expected_duration")),
        ("abnormal_volatility", "异常波动", 0.0, ("volatility_period", "volatility_type", "company_explanation", "regulatory_inquiry")),
    )),
)
# Industry groups and their industries.
INDUSTRIES = (
    ("新能源与电力", ("电气设备", "新型电力", "火力发电", "水力发电", "供气供热")),
    ("科技", ("半导体", "元器件", "IT设备", "软件服务", "通信设备", "电信运营", "互联网")),
    ("医药生物", ("化学制药", "生物制药", "中成药", "医疗保健", "医药商业")),
    ("金融", ("银行", "证券", "保险", "多元金融")),
    ("房地产", ("全国地产", "区域地产", "园区开发", "房产服务", "装修装饰", "建筑工程")),
    ("消费", ("食品", "乳制品", "白酒", "啤酒", "红黄酒", "软饮料", "家用电器", "家居用品", "服饰", "纺织", "日用化工", "百货", "超市连锁", "电器连锁", "造纸")),
    ("商贸服务", ("批发业", "商贸代理", "商品城", "其他商业", "酒店餐饮", "旅游景点", "旅游服务")),
    ("传媒文化", ("影视音像", "出版业", "文教休闲", "广告包装")),
    ("钢铁", ("普钢", "特种钢", "钢加工", "焦炭加工")),
    ("有色煤炭", ("煤炭开采", "铜", "铝", "铅锌", "黄金", "小金属")),
    ("石油化工", ("石油开采", "石油加工", "石油贸易", "化工原料", "化纤", "塑料", "橡胶", "染料涂料", "农药化肥", "矿物制品")),
    ("建筑建材", ("水泥", "玻璃", "陶瓷", "其他建材")),
    ("工业制造", ("专用机械", "机械基件", "工程机械", "机床制造", "化工机械", "轻工机械", "纺织机械", "农用机械", "运输设备", "船舶", "电器仪表")),
    ("汽车", ("汽车整车", "汽车配件", "汽车服务", "摩托车")),
    ("交通运输", ("航空", "机场", "空运", "港口", "水运", "公路", "路桥", "铁路", "公共交通", "仓储物流")),
    ("农林牧渔", ("种植业", "林业", "渔业", "饲料", "农业综合")),
    ("公用环保", ("环境保护", "水务")),
    ("综合", ("综合类",)),
)
DEFAULT_GROUP = "其他"
# Record statuses in order, and scoring, pipeline and unit constants.
STATUSES = ("fetched", "preprocessed", "classified", "extracted", "scored", "reported", "failed")
DEFAULTS = {"direction": 0.0, "magnitude": 0.5, "surprise": 0.5, "credibility": 0.8}
SOURCE_CREDIBILITY = {"regulatory_filing": 0.95, "company_announcement": 0.90, "media_report": 0.50, "analyst_report": 0.60}
LOOKBACK_DAYS, MIN_CONFIDENCE, HIGH_IMPACT, TOP_N = 3, 0.6, 0.5, 10
GENERIC_FIELDS = ("event_type", "direction", "summary", "key_entities")
AMOUNT_FIELDS = (
    "contract_amount", "bid_amount", "buyback_amount_max", "involved_amount", "default_amount", "penalty_amount", "placement_amount",
    "transaction_amount", "sale_amount", "bond_amount", "investment_amount", "revenue", "net_profit",
)
RISK_SUBS = ("litigation", "penalty", "investigation", "debt_default", "st_delisting_risk")
UNIT_LABELS = {"CNY": "元", "CNY_100M": "亿元", "pct": "%", "shares": "股", "万元": "万元", "万": "万"}


@dataclass(frozen=True)
class Event:
    major: str
    major_label: str
    sub: str
    label: str
    baseline: float
    fields: tuple[str, ...]


def events() -> list[Event]:
    return [Event(m, ml, s, sl, b, f) for m, ml, subs in EVENTS for s, sl, b, f in subs]


def industries() -> list[tuple[str, str]]:
    """(industry, group) pairs."""
    return [(i, g) for g, own in INDUSTRIES for i in own]


def events_df(spark: SparkSession, rows: list[Event] | None = None) -> DataFrame:
    data = [(e.major, e.major_label, e.sub, e.label, e.baseline, list(e.fields)) for e in rows or events()]
    return _local(spark, data, "major string, major_label string, sub string, sub_label string, direction_baseline double, fields array<string>")


def industries_df(spark: SparkSession) -> DataFrame:
    return _local(spark, industries(), "industry string, industry_group string")


def statuses_df(spark: SparkSession) -> DataFrame:
    return _local(spark, [(i, s) for i, s in enumerate(STATUSES)], "place int, status string")


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as one literal, so no Python worker stands in its plan."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows], ensure_ascii=False)
    return spark.range(1).select(F.explode(F.from_json(F.lit(data), f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in schema.split(', '))}>>")).alias("r")).select("r.*")


def load_events(path: str, spark: SparkSession) -> list[Event]:
    """A taxonomy from JSON lines (major, major_label, sub, sub_label, direction_baseline, fields); a missing file is an empty registry."""
    try:
        rows = spark.read.json(path).collect()
    except Exception as e:  # a missing path is an analysis error
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return [Event(r["major"], r["major_label"], r["sub"], r["sub_label"], r["direction_baseline"], tuple(r["fields"])) for r in rows]


def load_industries(path: str, spark: SparkSession) -> list[tuple[str, str]]:
    """(industry, group) pairs from JSON lines (group, industries), in the file's order; a missing file is an empty registry."""
    try:
        rows = spark.read.schema("group string, industries array<string>").json(path).collect()
    except Exception as e:  # a missing path is an analysis error
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise
    return [(i, r["group"]) for r in rows for i in r["industries"] or []]


def literal_map(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def label(code: Column, table: dict[str, str]) -> Column:
    """A display label, or the code itself."""
    return F.coalesce(F.try_element_at(literal_map(table), code), code)


def resolve_group(industry: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    """An industry's group; null, empty and unmapped ones get the default group. The pairs are the built-in ones, or a loaded registry's."""
    known = dict(industries() if pairs is None else pairs)
    return F.coalesce(F.try_element_at(literal_map(known), industry), F.lit(DEFAULT_GROUP)) if known else F.lit(DEFAULT_GROUP)
