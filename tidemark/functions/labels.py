"""Labels of codes, and the formats of ranks, dates, times and source names for display."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels by kind and code.
LABELS = {
    "tier": {"immediate": "即时提醒", "daily": "进入日报", "archive": "归档观察"},
    "category": {
        "partnership": "合作 / 伙伴", "product": "产品 / 技术", "event": "展会 / 活动", "regulatory": "监管 / 申报", "finance": "资本 / 财务", "award": "奖项 / 认可",
        "market": "市场扩张", "company": "公司动态", "video": "视频 / Webinar", "research": "论文 / 研究", "uncategorized": "未分类",
    },
    "signal_type": {
        "news": "新闻", "event": "活动 / 生态", "video": "视频", "filing": "公司公告", "regulatory": "监管风险", "funding": "研发资助 / 政策", "research": "论文研究",
        "clinical_trial": "临床试验",
    },
    "method": {"active": "现在在用", "available": "可用待接", "planned": "未来开发", "covered": "已覆盖", "manual": "人工观察", "blocked": "不接入", "paid": "付费候选"},
    "operational": {"reachable": "运行正常", "error": "请求失败", "not_running": "未发起请求"},
    "health": {"productive": "有效产出", "archive_only": "仅归档", "quiet": "暂无内容", "pending": "待配置", "error": "抓取异常"},
    "health_note": {
        "productive": "本轮有内容进入日报", "archive_only": "本轮产出均为归档观察", "quiet": "时效窗口内暂无新内容", "pending": "需完成配置后再启用", "error": "本轮请求失败",
    },
    "region": {"japan": "日本", "china": "中国", "korea": "韩国", "southeast_asia": "东南亚", "north_america": "北美", "europe": "欧洲", "global": "全球 / 未识别"},
    "role": {"self": "本公司", "competitor": "竞品", "customer": "客户", "industry": "行业观察"},
}
# Event types with their long and short labels in two languages.
EVENT_TYPES = {
    "product_platform": ("产品与平台", "产品平台", "Product and platform", "Product"),
    "target_therapy": ("靶点与治疗方向", "靶点疗法", "Targets and therapy areas", "Targets"),
    "clinical_regulatory": ("临床与监管", "临床监管", "Clinical and regulatory", "Clinical"),
    "partnership_deal": ("合作、授权与交易", "合作交易", "Partnerships, licensing and deals", "Deals"),
    "customer_demand": ("客户需求与潜在机会", "客户需求", "Customer demand and opportunities", "Demand"),
    "market_activity": ("市场活动与渠道", "市场活动", "Market activities and channels", "Events"),
    "regional_expansion": ("地区扩张与市场进入", "地区扩张", "Regional expansion and market entry", "Region"),
    "quality_supply": ("质量、GMP 与供应链", "质量供应", "Quality, GMP and supply chain", "Quality"),
    "corporate_strategy": ("公司战略与组织动作", "公司战略", "Corporate strategy and organization", "Strategy"),
}
# Phrases of source names and their Chinese form; the first four in any case of letters.
SOURCE_PHRASES = (
    (r"(?i)company pool indexed RSS", "公司池索引 RSS"), (r"(?i)indexed RSS", "索引 RSS"), (r"(?i)(?<![A-Za-z0-9_])backup(?![A-Za-z0-9_])", "备份"),
    (r"(?i)official news", "官网新闻"), (r"(?i)official site", "官网"), (r"(?i)official Insights", "官方 Insights"),
)


def _named(c: Column, pairs: dict[str, str]) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.coalesce(F.try_element_at(m, c), c)


def label(c: Column, kind: str) -> Column:
    """The label of a code of LABELS[kind]; an unknown code is its own, null stays null."""
    return _named(c, LABELS[kind])


def event_label(c: Column, english: bool = False, short: bool = False) -> Column:
    return _named(c, {k: v[2 * english + short] for k, v in EVENT_TYPES.items()})


def rank_text(c: Column) -> Column:
    """A rank in two digits; -- for none or one that isn't positive."""
    return F.when(c > 0, F.when(c < 10, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))).otherwise("--")


def time_text(c: Column) -> Column:
    """A time as MM/dd HH:mm in UTC; what is no time stays as it is."""
    return F.coalesce(F.date_format(c.try_cast("timestamp"), "MM/dd HH:mm"), c)


def date_text(event_day: Column, published: Column, as_of: Column) -> Column:
    """What is known of an item's date: the day of its event with the days until it, else of its publication."""
    until = F.datediff(event_day, as_of)
    ahead = F.when(until > 0, F.concat(F.lit(" · "), until.cast("string"), F.lit(" 天后"))).when(until == 0, " · 今天").otherwise(F.concat(F.lit(" · "), F.abs(until).cast("string"), F.lit(" 天前")))
    event = F.concat(F.lit("活动 "), event_day.cast("string"), ahead)
    return F.coalesce(event, F.when(F.coalesce(published, F.lit("")) != "", F.concat(F.lit("发布 "), published)), F.lit("日期待核对"))


def day_mark(as_of: Column, days_ago: Column) -> Column:
    """The mark of a day on a chart that ends at as_of: month/day without leading zeros."""
    d = F.date_sub(as_of, days_ago)
    return F.concat_ws("/", F.month(d).cast("string"), F.dayofmonth(d).cast("string"))


def source_names(labels: Column, chinese: bool) -> Column:
    """The names of an item's sources in one text, in Chinese with the known phrases replaced. Empty names are left out."""
    text = F.array_join(F.filter(labels, lambda x: x != ""), " + ")
    if chinese:
        for pattern, to in SOURCE_PHRASES:
            text = F.regexp_replace(text, pattern, to)
    return text
