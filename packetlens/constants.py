"""Ports, thresholds, word lists and code tables the analytics are defined by.

Everything here is a plain value whose exact content decides results. Nothing is computed.
"""

# --- protocols ------------------------------------------------------------------------------

# Bit of the TCP flag byte -> flag name.
TCP_FLAG_BITS = {
    0x01: "FIN",
    0x02: "SYN",
    0x04: "RST",
    0x08: "PSH",
    0x10: "ACK",
    0x20: "URG",
}
SYN_BIT = 0x02
ACK_BIT = 0x10

UNKNOWN = "UNKNOWN"

# Transport and application protocols of the data model.
PROTOCOLS = ["TCP", "UDP", "ICMP", "IGMP", "OTHER"]
APP_PROTOCOLS = ["HTTP", "HTTPS", "DNS", "TLS", "SSH", "FTP", "SMTP", "SMB", "RDP", "DHCP", "NTP"]

# Well-known port -> application protocol. UNKNOWN entries end the search.
PORT_APP_PROTOCOL = {
    20: "FTP",
    21: "FTP",
    22: "SSH",
    23: UNKNOWN,
    25: "SMTP",
    53: "DNS",
    67: "DHCP",
    68: "DHCP",
    80: "HTTP",
    110: UNKNOWN,
    123: "NTP",
    143: UNKNOWN,
    443: "HTTPS",
    445: "SMB",
    465: "SMTP",
    587: "SMTP",
    993: UNKNOWN,
    995: UNKNOWN,
    3389: "RDP",
    8080: "HTTP",
    8443: "HTTPS",
}

# Port -> display name.
PORT_NAMES = {
    20: "FTP-Data",
    21: "FTP",
    22: "SSH",
    23: "Telnet",
    25: "SMTP",
    53: "DNS",
    67: "DHCP",
    68: "DHCP",
    80: "HTTP",
    110: "POP3",
    123: "NTP",
    143: "IMAP",
    443: "HTTPS",
    445: "SMB",
    465: "SMTPS",
    587: "SMTP",
    993: "IMAPS",
    995: "POP3S",
    1433: "MSSQL",
    1434: "MSSQL",
    3306: "MySQL",
    3389: "RDP",
    5432: "PostgreSQL",
    5900: "VNC",
    8080: "HTTP-Alt",
    8443: "HTTPS-Alt",
}

# Ports a vertical scan is reported to have touched.
SENSITIVE_PORTS = [
    21, 22, 23, 25, 53, 80, 110, 135, 139, 143, 443, 445,
    993, 995, 1433, 1521, 3306, 3389, 5432, 5900, 6379,
    8080, 8443, 27017,
]

# DNS record type codes. 10 is added so that NULL queries are named.
DNS_TYPES = {
    1: "A",
    2: "NS",
    5: "CNAME",
    6: "SOA",
    10: "NULL",
    12: "PTR",
    15: "MX",
    16: "TXT",
    28: "AAAA",
    33: "SRV",
    255: "ANY",
}

# DNS response codes.
DNS_RCODES = {
    0: "NOERROR",
    1: "FORMERR",
    2: "SERVFAIL",
    3: "NXDOMAIN",
    4: "NOTIMP",
    5: "REFUSED",
}

# Payload prefixes taken as HTTP.
HTTP_REQUEST_PREFIXES = ["GET ", "POST", "HEAD", "PUT ", "DELE"]
HTTP_RESPONSE_PREFIX = "HTTP/"
TLS_HANDSHAKE_BYTE = 0x16

# --- address ranges -------------------------------------------------------------------------

# IPv4 networks the address registry calls private, and the two exceptions.
REGISTRY_PRIVATE_V4 = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
]
REGISTRY_PUBLIC_EXCEPTIONS_V4 = ["192.0.0.9/32", "192.0.0.10/32"]
MULTICAST_V4 = "224.0.0.0/4"

# Content-delivery and cloud ranges whose addresses are not looked up.
CDN_RANGES = [
    "104.16.0.0/12",
    "172.64.0.0/13",
    "173.245.48.0/20",
    "103.21.244.0/22",
    "103.22.200.0/22",
    "103.31.4.0/22",
    "141.101.64.0/18",
    "108.162.192.0/18",
    "190.93.240.0/20",
    "188.114.96.0/20",
    "197.234.240.0/22",
    "198.41.128.0/17",
    "162.158.0.0/15",
    "23.0.0.0/12",
    "23.192.0.0/11",
    "151.101.0.0/16",
    "34.0.0.0/8",
    "13.32.0.0/15",
    "13.35.0.0/16",
    "13.107.0.0/16",
]

# --- names ----------------------------------------------------------------------------------

# Top-level domains often abused; the second list extends the first.
SUSPICIOUS_TLDS = ["tk", "xyz", "top", "pw", "cc", "icu", "buzz"]
SUSPICIOUS_TLDS_EXTENDED = ["tk", "xyz", "top", "pw", "cc", "icu", "buzz", "ml", "ga", "cf"]

# Second-level labels after which a parent domain keeps three labels.
SECOND_LEVEL_LABELS = ["co", "com", "org", "net", "gov", "edu"]

# Look-alike characters and their replacement, applied in this order.
LOOKALIKE_CHARACTERS = {
    "0": "o",
    "1": "i",
    "3": "e",
    "4": "a",
    "5": "s",
    "7": "t",
    "8": "b",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "l",
}
LOOKALIKE_PAIRS = {"rn": "m", "vv": "w"}

# Brand names that look-alike domains imitate.
BRANDS = [
    "google", "microsoft", "apple", "amazon", "facebook", "twitter",
    "instagram", "linkedin", "paypal", "netflix", "spotify", "dropbox",
    "github", "gitlab", "adobe", "oracle", "salesforce", "zoom",
    "slack", "discord", "whatsapp", "telegram", "signal",
]
MAX_EDIT_DISTANCE = 2

# Suffixes of names that never leave the local network.
LOCAL_SUFFIXES_SELECTION = [".local", ".lan", ".internal", ".arpa"]
LOCAL_SUFFIXES_CASCADE = [".local", ".lan", ".internal", ".localhost"]
LOCAL_SUFFIXES_PRIORITY = [".local", ".lan", ".internal"]
REVERSE_SUFFIXES = [".in-addr.arpa", ".ip6.arpa"]

# Major-provider domains skipped when priorities are assigned.
SAFE_DOMAINS_PRIORITY = [
    "google.com",
    "googleapis.com",
    "gstatic.com",
    "youtube.com",
    "microsoft.com",
    "windows.com",
    "windowsupdate.com",
    "office.com",
    "office365.com",
    "live.com",
    "amazon.com",
    "amazonaws.com",
    "cloudfront.net",
    "apple.com",
    "icloud.com",
    "facebook.com",
    "fbcdn.net",
    "twitter.com",
    "twimg.com",
    "github.com",
    "githubusercontent.com",
    "cloudflare.com",
    "akamai.net",
    "akamaitechnologies.com",
    "fastly.net",
]

# The same for the staged look-up, with five more entries.
SAFE_DOMAINS_CASCADE = SAFE_DOMAINS_PRIORITY + [
    "akadns.net",
    "akamaiedge.net",
    "msedge.net",
    "azure.com",
    "bing.com",
]

# Parents whose random-looking host names are normal.
BENIGN_HIGH_ENTROPY_SUFFIXES = [
    "akamaiedge.net",
    "akamaihd.net",
    "cloudfront.net",
    "cloudflare.com",
    "fastly.net",
    "googleusercontent.com",
    "amazonaws.com",
    "azurewebsites.net",
    "blob.core.windows.net",
    "1e100.net",
]

# Tunnel tools recognised by a label inside the query name.
TUNNEL_TOOLS = ["dnscat", "dns2tcp", "iodine"]

# File-hosting services.
CLOUD_STORAGE_DOMAINS = [
    "dropbox.com",
    "drive.google.com",
    "docs.google.com",
    "onedrive.live.com",
    "1drv.ms",
    "box.com",
    "mega.nz",
    "mega.io",
    "mediafire.com",
    "sendspace.com",
    "wetransfer.com",
    "transfer.sh",
    "file.io",
    "0x0.st",
]

# Text-paste services.
PASTE_DOMAINS = [
    "pastebin.com",
    "paste.ee",
    "hastebin.com",
    "ghostbin.com",
    "dpaste.com",
    "paste.ubuntu.com",
    "gist.github.com",
    "privatebin.net",
    "termbin.com",
    "paste.mozilla.org",
]

# --- rankings -------------------------------------------------------------------------------

# Presentation order of severities, threat levels and priorities.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
THREAT_RANK = {"malicious": 0, "suspicious": 1, "unknown": 2, "clean": 3}
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# How many indicators of each priority are looked up; critical is not limited.
PRIORITY_CAPS = {"high": 5, "medium": 10, "low": 5}

# --- threat intelligence --------------------------------------------------------------------

# Abuse report category codes.
ABUSE_CATEGORIES = {
    1: "DNS Compromise",
    2: "DNS Poisoning",
    3: "Fraud Orders",
    4: "DDoS Attack",
    5: "FTP Brute-Force",
    6: "Ping of Death",
    7: "Phishing",
    8: "Fraud VoIP",
    9: "Open Proxy",
    10: "Web Spam",
    11: "Email Spam",
    12: "Blog Spam",
    13: "VPN IP",
    14: "Port Scan",
    15: "Hacking",
    16: "SQL Injection",
    17: "Spoofing",
    18: "Brute-Force",
    19: "Bad Web Bot",
    20: "Exploited Host",
    21: "Web App Attack",
    22: "SSH",
    23: "IoT Targeted",
}

# Words that make a pulse tag a malware family.
MALWARE_KEYWORDS = ["malware", "trojan", "rat", "ransomware", "botnet", "c2", "apt"]

# Cache lifetime in seconds by threat level, and the cache size.
CACHE_TTL_SECONDS = {
    "malicious": 6 * 3600,
    "suspicious": 12 * 3600,
    "clean": 24 * 3600,
    "unknown": 4 * 3600,
}
CACHE_MAX_SIZE = 10000

# Most indicators sent to the slow source, in the staged and the two-phase flow.
MAX_SLOW_LOOKUPS_CASCADE = 9
MAX_SLOW_LOOKUPS_TWO_PHASE = 10

# --- display filters ------------------------------------------------------------------------

# Protocol name -> display-filter word.
PROTOCOL_FILTER_WORDS = {
    "tcp": "tcp",
    "udp": "udp",
    "icmp": "icmp",
    "http": "http",
    "https": "tls",
    "tls": "tls",
    "dns": "dns",
    "ftp": "ftp",
    "ssh": "ssh",
    "telnet": "telnet",
    "smtp": "smtp",
    "imap": "imap",
    "pop": "pop",
    "smb": "smb",
    "smb2": "smb2",
    "rdp": "rdp",
    "dhcp": "dhcp",
    "arp": "arp",
}

# Detectors that have a filter category of their own; others are "custom".
DETECTOR_CATEGORIES = ["beacon", "dns_tunnel", "exfiltration", "port_scan"]

# --- report text ----------------------------------------------------------------------------

# Threat levels in the order they are searched, and the texts before them.
REPORT_THREAT_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MINIMAL"]
REPORT_THREAT_PREFIXES = ["OVERALL THREAT LEVEL: ", "**OVERALL THREAT LEVEL**: ", "THREAT LEVEL: "]

# Words a filter expression quoted in a report starts with.
REPORT_FILTER_FIELDS = [
    "ip.addr", "ip.src", "ip.dst", "tcp.port", "udp.port", "dns.qry.name", "frame.time",
]
