"""The remote mapping service: settings, status errors and the transport."""

from __future__ import annotations

import http.client
import json
import os
import ssl
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, field

from tessera.errors import BY_STATUS, ConfigError, MappingError, RequestTimeout
from tessera.schemas import DEFAULT_TIMEOUT

KEY_VARIABLE = "TESSERA_API_KEY"
#: Characters of a response that an error quotes.
QUOTED = 200
#: Bytes of an uploaded file that are in memory at once.
UPLOAD_BYTES = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Where the service is and how to ask it; plain data, so that executors get it too.

    ``timeout`` in seconds holds for connecting and for each wait for bytes, None
    for no limit; ``connect_timeout`` replaces it for connecting; ``ca_file``:
    certificates to trust in place of the system's; ``proxy``: host:port that
    requests go through.
    """

    base_url: str
    api_key: str = ""
    timeout: float | None = DEFAULT_TIMEOUT
    headers: dict = field(default_factory=dict)
    connect_timeout: float | None = None
    ca_file: str | None = None
    proxy: str | None = None

    def __post_init__(self):
        key = self.api_key or os.environ.get(KEY_VARIABLE, "")
        if not key:
            raise ConfigError(f"no key for the service: give api_key or set {KEY_VARIABLE}")
        if urllib.parse.urlsplit(self.base_url).scheme not in ("http", "https"):
            raise ConfigError(f"no address of a service: {self.base_url!r}")
        object.__setattr__(self, "api_key", key)
        object.__setattr__(self, "base_url", self.base_url.rstrip("/"))


def error_for(status: int, headers, body: str) -> MappingError | None:
    """The error that a status stands for; None below 400."""
    for first, last, kind, quotes in BY_STATUS:
        if first <= status <= last:
            wait = str(headers.get("Retry-After") or "").strip()
            pause = float(wait) if wait.replace(".", "", 1).isdigit() else None
            said = f": {body[:QUOTED]}" if quotes and body else ""
            return kind(f"the service answered {status} ({kind.__name__}){said}", status_code=status, retry_after=pause)
    return None


class HttpTransport:
    """Sends JSON over one connection that is kept open between requests.

    It opens with the first request and again when the service has closed it;
    ``with`` or ``close`` ends it. Pickled, it is settings alone, so each task
    opens its own connection. One instance works in one thread at a time.
    """

    def __init__(self, settings: Settings):
        self.settings, self._kept = settings, None

    def __getstate__(self):
        return {"settings": self.settings, "_kept": None}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        if self._kept is not None:
            self._kept.close()
            self._kept = None

    def _connect(self) -> http.client.HTTPConnection:
        own = self.settings
        to = urllib.parse.urlsplit(own.base_url)
        host, port = (own.proxy.rsplit(":", 1) if own.proxy else (to.hostname, to.port))
        options = {"port": int(port) if port else None, "timeout": own.connect_timeout or own.timeout}
        if to.scheme == "https":
            made = http.client.HTTPSConnection(host, context=ssl.create_default_context(cafile=own.ca_file), **options)
            if own.proxy:
                made.set_tunnel(to.hostname, to.port)
        else:
            made = http.client.HTTPConnection(host, **options)
        made.connect()
        made.sock.settimeout(own.timeout)
        return made

    def _ask(self, method: str, path: str, body, headers: dict) -> http.client.HTTPResponse:
        to = urllib.parse.urlsplit(self.settings.base_url)
        target = to.path + path if not self.settings.proxy or to.scheme == "https" else self.settings.base_url + path
        again = self._kept is not None and not isinstance(body, Iterator)
        while True:
            try:
                if self._kept is None:
                    self._kept = self._connect()
                self._kept.request(method, target, body, headers)
                return self._kept.getresponse()
            except (ConnectionError, http.client.BadStatusLine):
                # a kept connection may have been closed in the meantime: nothing was answered, ask once more
                self.close()
                if not again:
                    raise
                again = False

    def request(self, method: str, path: str, body=None, *, query: dict | None = None, headers: dict | None = None) -> http.client.HTTPResponse:
        """The response, its body unread; errors of the service and of the way to it are raised."""
        own = self.settings
        path += "?" + urllib.parse.urlencode(query) if query else ""
        sent = {"X-API-Key": own.api_key, "Content-Type": "application/json"} | own.headers | (headers or {})
        try:
            answer = self._ask(method, path, body, sent)
            if answer.status < 400:
                return answer
            text = answer.read().decode("utf-8", "replace")
        except TimeoutError as e:
            self.close()
            raise RequestTimeout(f"no answer to {method} {path.partition('?')[0]} in time") from e
        except (OSError, http.client.HTTPException) as e:
            self.close()
            raise MappingError(str(e) or type(e).__name__) from e
        raise error_for(answer.status, answer.headers, text)

    def text(self, method: str, path: str, body: str | None = None) -> str:
        answer = self.request(method, path, None if body is None else body.encode())
        try:
            return answer.read().decode()
        except TimeoutError as e:
            self.close()
            raise RequestTimeout(f"the answer to {method} {path} broke off") from e
        except (OSError, http.client.HTTPException) as e:
            self.close()
            raise MappingError(str(e) or type(e).__name__) from e

    def __call__(self, body: str) -> str:
        """One chunk: the transport that ``send_chunks`` takes."""
        return self.text("POST", "/map/batch", body)

    def single(self, request: dict) -> str:
        return self.text("POST", "/map/entity", json.dumps(request))

    def catalog(self, name: str) -> str:
        """entity-types, annotators or vocabularies."""
        return self.text("GET", f"/{name}")

    def health(self) -> dict:
        return json.loads(self.text("GET", "/health"))

    def dataset_lines(self, path: str, query: dict, content_type: str):
        """Uploads a file as a form field, a part at a time, and yields the lines of the answer as they come.

        Ended early, by ``close`` on what this returns, it closes file and connection.
        """
        mark = "tessera-" + os.urandom(12).hex()
        head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{os.path.basename(path)}"\r\nContent-Type: {content_type}\r\n\r\n'.encode()
        tail = f"\r\n--{mark}--\r\n".encode()
        headers = {"Content-Type": f"multipart/form-data; boundary={mark}", "Content-Length": str(len(head) + os.path.getsize(path) + len(tail))}

        def parts(f):
            yield head
            while data := f.read(UPLOAD_BYTES):
                yield data
            yield tail

        try:
            with open(path, "rb") as f:
                answer = self.request("POST", "/map/dataset/stream", parts(f), query=query, headers=headers)
                try:
                    for line in answer:
                        yield line.decode("utf-8", "replace").rstrip("\r\n")
                    if answer.length:
                        raise MappingError(f"the answer broke off {answer.length} bytes before its end")
                except TimeoutError as e:
                    raise RequestTimeout("no further line in time") from e
                except (OSError, http.client.HTTPException) as e:
                    raise MappingError(str(e) or type(e).__name__) from e
        finally:
            self.close()
