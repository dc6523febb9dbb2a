"""Lines of many languages and tools, written after the rules and measured as they are."""

import random

from palimpsest.llm import secrets

RNG = random.Random(77)


def token(n: int, chars: str = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") -> str:
    return "".join(RNG.choices(chars, k=n))


HEX = "0123456789abcdef"
SECRETS = [
    f'aws_secret_access_key = "{token(40)}"', f"export STRIPE_KEY=sk_live_{token(24)}", f'headers = {{"Authorization": "Bearer {token(32)}"}}', f"DATABASE_URL=mysql://app:{token(14)}@db.internal:3306/app",
    f'  password: "{token(12)}"', f"spring.datasource.password={token(10)}", f"<password>{token(11)}</password>", f'client = Client(api_key="{token(36)}")', f"RUN curl -H 'X-Api-Key: {token(28)}' https://x.example", f'  "token": "{token(40)}",',
    f"machine host.example login me password {token(12)}", f'$config["db_password"] = "{token(13)}";', f'conn = psycopg2.connect(host="h", user="u", password="{token(12)}")', f"ALTER USER app IDENTIFIED BY '{token(12)}';", f"mysql -u root -p{token(12)} app < dump.sql",
    f"redis://:{token(20)}@cache.internal:6379/0", f'const jwtSecret = "{token(44)}";', f"GITHUB_TOKEN: ghp_{token(36)}", f'slack_token = "xoxb-{token(11, "0123456789")}-{token(24)}"', f"//registry.example/:_authToken={token(36)}", f"git clone https://bot:{token(20)}@git.example/x.git",
    f'private static final String PASSWORD = "{token(9)}";', f"--from-literal=password={token(12)}", f"PGPASSWORD={token(12)} psql -h db", f'let apiSecret = "{token(32, HEX)}"', f"auth_token: '{token(32, HEX)}'", f'azure_key = "{token(43)}="', f"# old password was {token(10)}9", f"sshpass -p {token(10)} ssh me@host",
    f'os.environ["OPENAI_API_KEY"] = "sk-{token(48)}"',
]
OTHERS = [
    'password = os.environ["DB_PASSWORD"]', "password: ${DB_PASSWORD}", 'api_key = "<your-api-key>"', 'token = request.headers.get("X-Token")', f'"integrity": "sha512-{token(86)}=="', f"commit {token(40, HEX)}", "id: 3f2504e0-4f89-41d3-9a0c-0305e82c3301", 'password = ""', "PASSWORD=changeme123", 'secret = "********"', "def set_password(self, password):",
    "token = tokenizer.next_token()", 'label = "Reset password"', "if (password.length < 8) {", "password_hash VARCHAR(255) NOT NULL,", "https://user@host.example/path", 'const keyCode = "ArrowLeft";', "image: registry.example/app@sha256:" + token(64, HEX), 'etag = "' + token(32, HEX) + '"', "ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABAQ me@host", "<input type='password' name='password'>",
    "print('token:', token)", "access_token = None", 'secretKeyRef: {name: "db", key: "password"}', "auth: {enabled: true}", 'class TokenBucket: rate = "100/minute"', "raise ValueError('password too short')", "X-Api-Key: {{ api_key }}", "theme_color = '#1a2b3c4d'", "trace_id=" + token(32, HEX),
]


def test_held_out_lines():
    detector = secrets.Detector()
    found = detector.spans(SECRETS + OTHERS)
    missed = [x for x, f in zip(SECRETS, found) if not f]
    wrong = [(x, f) for x, f in zip(OTHERS, found[len(SECRETS) :]) if f]
    recall, precision = 1 - len(missed) / len(SECRETS), (len(SECRETS) - len(missed)) / (len(SECRETS) - len(missed) + len(wrong))
    print(f"recall {recall:.2f}, precision {precision:.2f}")
    assert recall >= 0.8 and precision >= 0.9, (recall, precision, missed, wrong)
