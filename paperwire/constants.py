"""Texts and parameters a digest must reproduce exactly."""

# --- fixed values -----------------------------------------------------------
PUBMED_LINK = "https://pubmed.ncbi.nlm.nih.gov/"
DOI_LINK = "https://doi.org/"
DOI_MARK = ". doi: "
AUTHOR_SEPARATOR = "; "

SOURCE_ARXIV = "arXiv"
SOURCE_BIORXIV = "bioRxiv"
SOURCE_CHEMRXIV = "chemRxiv"

# Order in which the sources are appended to the digest.
SOURCE_ORDER = ("pubmed", "biorxiv", "chemrxiv", "arxiv")

ARXIV_TOP = 10
CHEMRXIV_LIMIT = 50

SYSTEM_MESSAGE = "You are a helpful assistant."
BASE_PROMPT = (
    "以下は英語学術論文のアブストラクトです。本論文の主張を、端的に示す10個程度の日本語の単語を"
    '", "で区切って示していただけますか？なお、日本語的に不可解な単語は無理に訳さずに英語の単語のまま表現してください。'
)
PROMPT_GAP = "　"
MODEL = "gpt-4-0125-preview"
TEMPERATURE = 1
MAX_TOKENS = 1001
TOP_P = 1
FREQUENCY_PENALTY = 0
PRESENCE_PENALTY = 0

HEADER_TIME_FORMAT = "yyyy/MM/dd HH:mm"
HEADER_ZONE = "+09:00"
HEADER = "{time} | {source} | {position}/{total}"
MESSAGES = {
    "teams": "**{header}** <br> **[{title}]({link})** <br> {authors} <br><br> {keywords} <br><br> ",
    "line": "{header}\n{title}\n{link}\n{authors}\n\n{keywords}",
    "slack": "*{header}*\n\n <{link}|*{title}*>\n {authors} \n\n {keywords}",
    "discord": "**{header}**\r**[{title}](<{link}>)**\r{authors}\r\r{keywords}\r\r​",
}
DISCORD_USERNAME = "LA_Article_Deliver"
# ---------------------------------------------------------------------------
