"""Vocabularies and notations of events, impacts and figures.

All values here are fixed: results must agree on them.
"""

from __future__ import annotations

EVENT_TYPES = """
earnings_report revenue_growth revenue_decline profit_growth profit_decline guidance_update analyst_upgrade analyst_downgrade price_target_change product_launch partnership
merger_acquisition lawsuit regulatory_investigation executive_change layoffs dividend_announcement share_buyback debt_financing stock_split macroeconomic_event supply_chain_event
recession_inflation_interest_rate options_activity portfolio_holding stock_performance market_cap_milestone business_segment_performance market_share competitive_position
market_commentary valuation_multiple balance_sheet cash_flow analyst_estimate capital_allocation price_level_range other
""".split()
#: Event type: other ways to write it.
EVENT_TYPE_ALIASES = {
    "stock_performance": "stock_return stock_price_return share_price_return share_return",
    "market_cap_milestone": "market_cap market_cap_growth market_cap_grow market_cap_increase",
    "business_segment_performance": "geographic_expansion geographic_scale",
    "price_target_change": "price_target price_targets analyst_price_target target_price consensus_price_target average_price_target upside_target",
    "capital_allocation": "capital_spending capital_expenditure capital_expenditures investment_spending cost_reduction cost_savings",
    "share_buyback": "share_repurchase",
    "valuation_multiple": "pe_ratio p_e_ratio price_to_earnings forward_pe valuation valuation_ratio price_to_book ev_ebitda",
    "cash_flow": "free_cash_flow fcf operating_cash_flow cash_burn",
    "balance_sheet": "debt debt_level long_term_debt net_debt cash_position leverage liquidity",
    "analyst_estimate": "earnings_estimate consensus_estimate eps_estimate estimate_revision",
    "price_level_range": "52_week_range price_range stock_price_level",
}
POSITIVE_EVENT_TYPES = "revenue_growth profit_growth analyst_upgrade product_launch partnership dividend_announcement share_buyback market_cap_milestone market_share".split()
NEGATIVE_EVENT_TYPES = "revenue_decline profit_decline analyst_downgrade lawsuit regulatory_investigation layoffs debt_financing supply_chain_event".split()
MIRRORED_EVENT_TYPES = "supply_chain_event competitive_position partnership business_segment_performance market_commentary".split()
#: Event type: relation of the event to its company; others are EVENT_INVOLVES_COMPANY.
COMPANY_RELATIONS = {
    "earnings_report": "REPORTS_EARNINGS_FOR", "revenue_growth": "REVENUE_GROWTH_FOR", "revenue_decline": "REVENUE_DECLINE_FOR", "profit_growth": "PROFIT_GROWTH_FOR",
    "profit_decline": "PROFIT_DECLINE_FOR", "guidance_update": "UPDATES_GUIDANCE_FOR", "analyst_upgrade": "ANALYST_UPGRADE_FOR", "analyst_downgrade": "ANALYST_DOWNGRADE_FOR",
    "price_target_change": "PRICE_TARGET_CHANGE_FOR", "product_launch": "PRODUCT_LAUNCH_BY", "partnership": "PARTNERSHIP_INVOLVES", "merger_acquisition": "MERGER_ACQUISITION_INVOLVES",
    "lawsuit": "LEGAL_RISK_FOR", "regulatory_investigation": "REGULATORY_RISK_FOR", "executive_change": "EXECUTIVE_CHANGE_AT", "layoffs": "LAYOFFS_AT",
    "dividend_announcement": "DIVIDEND_ANNOUNCEMENT_FOR", "share_buyback": "SHARE_BUYBACK_FOR", "debt_financing": "DEBT_FINANCING_FOR", "stock_split": "STOCK_SPLIT_FOR",
    "macroeconomic_event": "MACRO_IMPACT_ON", "supply_chain_event": "SUPPLY_CHAIN_IMPACT_ON", "recession_inflation_interest_rate": "MACRO_RATE_IMPACT_ON",
    "options_activity": "OPTIONS_ACTIVITY_FOR", "portfolio_holding": "PORTFOLIO_HOLDING_OF", "stock_performance": "STOCK_PERFORMANCE_FOR",
    "market_cap_milestone": "MARKET_CAP_MILESTONE_FOR", "business_segment_performance": "BUSINESS_SEGMENT_PERFORMANCE_FOR", "market_share": "MARKET_SHARE_CHANGE_FOR",
    "competitive_position": "COMPETITIVE_POSITION_FOR", "market_commentary": "MARKET_COMMENTARY_MENTIONS", "valuation_multiple": "VALUATION_MULTIPLE_FOR",
    "balance_sheet": "BALANCE_SHEET_FOR", "cash_flow": "CASH_FLOW_FOR", "analyst_estimate": "ANALYST_ESTIMATE_FOR", "capital_allocation": "CAPITAL_ALLOCATION_BY",
    "price_level_range": "PRICE_LEVEL_FOR",
}
#: Impact type: relation of the event to the company it bears on; others are RELATED_TO_ANCHOR.
IMPACT_RELATIONS = {
    "direct": "DIRECTLY_IMPACTS_ANCHOR", "competitor": "COMPETES_WITH_ANCHOR", "supplier_customer": "SUPPLY_CUSTOMER_IMPACT_ON_ANCHOR", "partner": "PARTNERS_WITH_ANCHOR",
    "peer_comparison": "PEER_COMPARED_WITH_ANCHOR", "ecosystem": "ECOSYSTEM_IMPACT_ON_ANCHOR", "portfolio": "PORTFOLIO_EXPOSURE_TO_ANCHOR", "macro": "MACRO_IMPACT_ON_ANCHOR",
    "regulatory": "REGULATORY_IMPACT_ON_ANCHOR", "market_sentiment": "MARKET_SENTIMENT_IMPACT_ON_ANCHOR", "mentioned": "MENTIONS_ANCHOR_COMPANY",
}
#: Impact type by the marks it is told by, in the order in which they are tried.
IMPACT_MARKS = [
    ("direct", "direct|involves_ticker|same_company"), ("peer_comparison", "market_share|peer"), ("competitor", "compet|rival"), ("supplier_customer", "supplier|customer|supply_chain|vendor|client"),
    ("partner", "partner|partnership"), ("ecosystem", "ecosystem|platform|segment|product"), ("portfolio", "portfolio|holding|weight"), ("macro", "macro|inflation|interest|recession|market_commentary"),
    ("regulatory", "regulatory|lawsuit|legal"), ("market_sentiment", "sentiment|stock_performance|options"), ("mentioned", "mention|related"),
]
#: Impact type by event type, for companies that are only named; others are mentioned.
INFERRED_IMPACTS = {
    "supplier_customer": "supply_chain_event", "peer_comparison": "competitive_position market_share", "partner": "partnership", "macro": "macroeconomic_event recession_inflation_interest_rate",
    "regulatory": "lawsuit regulatory_investigation", "portfolio": "portfolio_holding", "market_sentiment": "stock_performance options_activity analyst_upgrade analyst_downgrade price_target_change",
    "ecosystem": "product_launch business_segment_performance",
}
NEUTRAL_MARKS = "neutral mixed uncertain unknown unclear ambiguous indirect none no_clear".split()
POSITIVE_MARKS = "positive up upward increase increased benefit beneficial good favorable favourable tailwind bullish opportunity gain growth improve".split()
NEGATIVE_MARKS = "negative down downward decrease decreased bad harm harmful adverse unfavorable unfavourable headwind bearish risk pressure decline loss".split()
POSITIVE_WORDS = "up rose risen rise gain gained gains growth grew soared jumped climbed increased higher bullish outperform".split()
NEGATIVE_WORDS = "down fell fall fallen decline declined loss lost off dropped plunged decreased lower bearish underperform".split()
DEMAND_SIGNS = [
    "high demand", "strong demand", "overwhelming demand", "demand from", "demand-driven", "backlog", "line out the door", "many other customers", "can't keep up with demand",
    "cannot keep up with demand", "can not keep up with demand", "not able to keep up with demand",
]
SHORTAGE_SIGNS = [
    "cannot supply enough", "can't supply enough", "can not supply enough", "cannot deliver enough", "can't deliver enough", "can not deliver enough", "not able to get enough",
    "not being able to get enough", "can't keep up", "cannot keep up", "can not keep up",
]
HARM_SIGNS = [
    "lost customer", "lost customers", "lost revenue", "lost sales", "cancelled orders", "canceled orders", "order cancellations", "penalty", "penalties", "reputational harm",
    "reputation damage", "demand weakness", "weak demand", "revenue decline", "sales decline",
]
EXCHANGES = "NASDAQ|NYSE|AMEX|OTC|OTCMKTS|NYSEARCA"
LEGAL_SUFFIXES = "incorporated|corporation|company|limited|holdings|holding|inc|corp|co|ltd|plc|llc|lp|sa|ag|nv"
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Inc Corp Co Ltd LLC No Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec U.S U.K".split()
#: Figures and periods as they are mentioned; figures as they are compared; figures of evidence.
MENTIONS = (
    r"(?i)(?:[$€£]\s*)?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x|times|shares?|subscribers?|users?|customers?)?"
    r"|\b(?:fiscal|FY|Q[1-4]|quarter|year|month)\s+20\d{2}\b|\b(?:20\d{2}|19\d{2})\b|\b(?:No\.?\s*\d+|#\d+)\b"
    r"|\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|largest|top\s+\d+)\b|\b(?:double|doubled|triple|tripled|twice|half)\b"
)
APPROXIMATORS = r"\b(?:more than|roughly|nearly|about|approximately|around|over|under|at least|as of)\b"
VALUES = r"(?i)[-+]?\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x|times|shares?)?"
EVIDENCE_FIGURES = r"(?i)(?:\$?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|million|billion|trillion|x)?|\b(?:twice|double|triple|half)\b)"
FINANCE = (
    r"(?i)\b(?:stock|share|market|revenue|profit|income|earnings|sales|cash|valuation|market cap|return|gained|rose|grew|growth|declined|fell|portfolio|holding|rank|weight|customers"
    r"|subscribers|users|margin|guidance|target|dividend|buyback|acquisition|merger|lawsuit|regulatory|inflation|interest rate)\b"
)
PERIODS = r"(?i)\b(?:20\d{2}|19\d{2}|Q[1-4]|quarter|fiscal|year|month|week|today|yesterday)\b"
CAUSES = r"(?i)\b(?:because|due to|driven by|as a result|therefore|despite|led to|resulting in)\b"
#: Marks of promotion and disclosure: any of the first, or a name of the service with any of its marks, or a pattern.
PROMOTION = ["before you buy", "see the 10 stocks", "top stock picks", "stock advisor returns", "affiliate compensation", "board of directors"]
PROMOTED = {
    "stock advisor": ["top stock pick", "top stock picks", "best stocks", "10 stocks", "ten stocks", "wasn't one of them", "was not one of them", "newsletter", "market returns", "tripled"],
    "stock advisor service": ["return", "tripled", "outperformed"],
}
DISCLOSURES = [
    r"\b(?:has|have|holds?|held|owns?|owned)\s+positions?\s+in\b", r"\bholds?\s+positions?\s+in\s+and\s+recommends\b", r"\brecommends?\s+(?:long|short)\b.*\b(?:calls?|puts?)\b",
    r"\b(?:former|current)\s+ceo\b.*\bmember\b.*\bboard of directors\b",
]
SECTION_TYPES = "core_article_body financial_analysis author_disclosure publisher_promotion legal_disclaimer related_links metadata_or_footer unknown".split()
ALLOWED_SECTION_TYPES = "core_article_body financial_analysis unknown".split()
TIME_ROLES = "occurrence_date reported_period measurement_window guidance_period deadline future_effective_period announcement_date historical_event unknown".split()
TIME_GRANULARITIES = "day month quarter year range unknown".split()
