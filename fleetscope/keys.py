"""Natural keys shared by every relation.

``K`` identifies one collection on one server, ``SK`` one request of one
session inside that collection.
"""

K = ["server_id", "collection_time"]
SK = K + ["session_id", "request_id"]
