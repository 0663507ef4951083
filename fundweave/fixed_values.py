"""Texts, word lists, patterns and limits that decide the results.

Everything in this file is data that other modules must not restate.
"""

# --- fixed values: limits -------------------------------------------------
CHUNK_TOKENS = 500
OVERLAP_TOKENS = 0
TOP_K = 10
MIN_SCORE = 0.3
MIN_CHUNKS = 3
DUPLICATE_GAP = 0.05
STRONG_SCORE = 0.8
VECTOR_DIM = 384
VECTOR_METRIC = "cosine"
STORED_TEXT_CHARS = 1000
DEFAULT_YEAR = 2023
EMBED_BATCH = 32
MIN_ANSWER_CHARS = 10
TOP_FUNDS = 5

# --- fixed values: namespaces --------------------------------------------
HOLDINGS = "holdings"
TRADES = "trades"

# --- fixed values: CSV cells read as missing ------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- fixed values: columns ------------------------------------------------
HOLDINGS_DATES = ["AsOfDate", "OpenDate", "CloseDate"]
HOLDINGS_NUMBERS = ["PL_DTD", "PL_QTD", "PL_MTD", "PL_YTD", "MV_Local", "MV_Base", "Qty", "Price"]
HOLDINGS_FILL = {"DirectionName": "Unknown", "SecurityTypeName": "Unknown"}
HOLDINGS_TEXTS = ["SecName", "PortfolioName", "Strategy1RefShortName", "CustodianName", "SecurityId"]
TRADES_NUMBERS = ["Quantity", "Price", "Principal", "TotalCash", "AllocationCash"]
TRADES_FILL = {
    "TradeDate": "00:00.0", "SettleDate": "00:00.0",
    "TradeTypeName": "Unknown", "SecurityType": "Unknown",
}
TRADES_TEXTS = ["Name", "PortfolioName", "Strategy1Name", "CustodianName", "Counterparty"]
OPEN_LABEL = "Open"

# --- fixed values: row texts ----------------------------------------------
HOLDINGS_ROW = """Security: {SecName} ({SecurityTypeName})
Portfolio: {PortfolioName}
Quantity: {Qty:,.0f}
Price: ${Price:,.2f}
Market Value (Base): ${MV_Base:,.2f}
P&L Year-to-Date: ${PL_YTD:,.2f}
P&L Quarter-to-Date: ${PL_QTD:,.2f}
Strategy: {Strategy1RefShortName}
Custodian: {CustodianName}
Direction: {DirectionName}
Open Date: {OpenDate}
---"""

TRADES_ROW = """Trade Type: {TradeTypeName}
Security: {Name} ({SecurityType})
Portfolio: {PortfolioName}
Quantity: {Quantity:,.0f}
Price: ${Price:,.2f}
Total Cash: ${TotalCash:,.2f}
Principal: ${Principal:,.2f}
Trade Date: {TradeDate}
Strategy: {Strategy1Name}
Custodian: {CustodianName}
Counterparty: {Counterparty}
---"""

# --- fixed values: question routing ---------------------------------------
AGGREGATION_PATTERNS = [
    r"which fund.*best",
    r"which fund.*performed",
    r"which fund.*better",
    r"compare.*funds",
    r"top.*funds",
    r"rank.*funds",
    r"all funds",
    r"fund performance",
    r"best.*yearly.*p[&/]l",
    r"highest.*p[&/]l",
    r"lowest.*p[&/]l",
    r"funds.*better",
    r"funds.*worse",
    r"total.*all funds",
    r"aggregate.*funds",
]
PL_WORDS = ["performance", "p&l", "profit", "loss", "pl_ytd", "yearly", "return"]
TRADE_WORDS = ["trade", "buy", "sell", "transaction", "purchase"]
HOLDING_WORDS = ["holding", "position", "quantity held", "owns"]

# --- fixed values: messages -----------------------------------------------
UNKNOWN_TYPE = "unknown"
REFUSAL = "Sorry, I cannot find the answer in the provided data"
NO_ANSWER = "Sorry, I could not generate an answer."
NO_AGGREGATES = "No aggregation data available."
NO_CHUNKS = "No relevant data found."
NO_FUND = "No data found for "
UNKNOWN = "Unknown"
RATE_LIMIT_MESSAGE = "⚠️ API rate limit exceeded. Please wait a moment and try again."
API_KEY_MESSAGE = "❌ Invalid API key. Please check your API key configuration."
GENERATION_FAILED = "Error generating answer: "

# --- fixed values: aggregation context ------------------------------------
PL_HEADER = "=== COMPLETE Fund Performance Rankings (Yearly P&L) ===\nThis includes ALL funds in the dataset:\n"
PL_FOOTER = "\nTotal Funds: "
HOLDINGS_COUNT_HEADER = "\n\n=== Holdings Count by Fund ==="
TRADES_COUNT_HEADER = "\n\n=== Trade Count by Fund ==="
CASH_HEADER = "\n\n=== Total Cash by Fund ==="
CHUNK_HEADER = "=== Chunk {no} (Fund: {fund}, Source: {file}, Relevance: {score}) ===\n{text}\n"

# --- fixed values: characters removed from answers ------------------------
CONTROL_CHARS = r"[\x00-\x09\x0B-\x1F\x7F]"
CONTROL_CHARS_WIDE = r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F-\x9F]"

# --- fixed values: prompts ------------------------------------------------
SYSTEM_PROMPT = """You are a financial data analyst assistant. Answer questions using ONLY the provided context chunks from holdings and trades data.

CRITICAL RULES:
1. Use ONLY the data in the CONTEXT below - do not use external knowledge
2. For fund performance: GROUP by PortfolioName, SUM(PL_YTD), rank DESC
3. For counts: COUNT non-zero Qty rows per fund
4. If insufficient data: respond exactly "Sorry, I cannot find the answer in the provided data"
5. Cite specific numbers and fund names from context
6. Be precise with numbers - use exact values from the data
7. Format currency values with $ and proper formatting

CONTEXT (Retrieved Chunks):
{context}

QUESTION: {question}

ANSWER (with specific numbers from context):"""

AGGREGATION_PROMPT = """You are a financial data analyst. Answer the question using ONLY the aggregated statistics below computed from ALL funds in the dataset.

CRITICAL RULES:
1. Use ONLY the statistics in the CONTEXT below
2. The data already includes ALL funds - no missing funds
3. Cite specific numbers and rankings from context
4. Format currency values clearly with $ and commas
5. When comparing funds, show multiple funds, not just the top one

FORMATTING INSTRUCTIONS:
- Use **bold** for fund names, key numbers, and important terms
- Use bullet points (*) for listing multiple items
- Use numbered lists (1., 2., 3.) for rankings
- Add blank lines between sections for readability
- Structure the answer with clear sections

CONTEXT (Complete Fund Statistics):
{context}

QUESTION: {question}

ANSWER (well-formatted with bold text, lists, and clear structure):"""

RETRIEVAL_PROMPT = """You are a financial data analyst. Answer the question using ONLY the provided context chunks from holdings and trades data.

CRITICAL RULES:
1. Use ONLY the data in the CONTEXT below
2. For counts: COUNT non-zero Qty rows per fund
3. If insufficient data: respond exactly "Sorry, I cannot find the answer in the provided data"
4. Cite specific numbers and fund names from context
5. Be precise with values from the data

FORMATTING INSTRUCTIONS:
- Use **bold** for fund names, security names, and key numbers
- Use bullet points (*) for listing holdings, securities, or multiple items
- Use numbered lists (1., 2., 3.) for rankings or ordered items
- Add blank lines between different funds or sections
- Keep the answer clear and well-structured

CONTEXT (Retrieved Chunks):
{context}

QUESTION: {question}

ANSWER (well-formatted with bold text, lists, and clear structure):"""
