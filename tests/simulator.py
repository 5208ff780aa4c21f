"""A sequential model of the keyspaces, written apart from the library, to hold the fold and the stream against."""

GONE_ON = {"array": {"GET"}, "rbtree": {"GET", "EXIST"}, "hash": {"GET", "MOD"}, "skiplist": {"GET", "EXIST"}}


class Keyspace:
    def __init__(self, engine):
        self.engine, self.items = engine, {}

    def run(self, op, key, value, ttl_ms, now):
        item = self.items.get(key)
        stale = item is not None and item["until"] is not None and item["until"] <= now
        if self.engine == "logical" and stale:
            self.items.pop(key)
            item, stale = None, False
        if op == "SET":
            self.items[key] = {"v": value, "until": None}
            return "OK"
        if op == "SETEX":
            self.items[key] = {"v": value, "until": now + ttl_ms}
            return "OK"
        if op == "DEL":
            return "1" if self.items.pop(key, None) is not None else "0"
        if item is None:
            return {"GET": None, "EXIST": "0", "TTL": "-2", "MOD": "ERR no such key", "EXPIRE": "0"}[op]
        if op == "GET":
            reply = None if stale else item["v"]
        elif op == "EXIST":
            reply = "0" if stale else "1"
        elif op == "TTL":
            left = None if item["until"] is None else item["until"] - now
            return "-1" if left is None else str(max(0, (left + 999) // 1000))
        elif op == "EXPIRE":
            item["until"] = now + ttl_ms
            return "1"
        elif op == "MOD":
            if stale and self.engine == "hash":
                reply = "ERR no such key"
            else:
                item["v"] = value
                reply = "OK"
        if stale and op in GONE_ON.get(self.engine, ()):
            del self.items[key]
        return reply

    def live(self, now):
        return {k: (i["v"], i["until"]) for k, i in self.items.items() if i["until"] is None or i["until"] > now}
