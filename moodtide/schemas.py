"""Explicit schemas, as DDL, of the files the engine reads and the names it gives their columns."""

#: Post files hold numbers that may be blank or written as 12.0, so they arrive as text
#: and ``cast_defaults`` types them.
POST_FILE = (
    "id string, url string, title string, score string, num_comments string, "
    "created_utc string, selftext string, upvote_ratio string"
)

#: One exported chat message; ``text`` is a string or an array of strings and objects.
MESSAGE = "id bigint, date string, text variant"
CHAT_EXPORT = "messages array<struct<id: bigint, date: string, text: variant>>"

LABELLED = "sentence string, label int"
LEXICON_FILE = "term string, polarity string"

#: Column of the market metrics file -> logical name.
INDICATOR_COLUMNS = {
    "BTC / Closing Price": "closing_price",
    "BTC / Active Addr Cnt": "active_addr_cnt",
    "BTC / NVT": "nvt",
    "BTC / Tx Cnt": "tx_cnt",
    "MACD": "macd",
    "SIGNAL": "signal",
    "EMA": "ema",
    "RSI": "rsi",
    "volume": "volume",
}
PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
