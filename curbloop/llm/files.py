"""Files in a shared folder, written by tasks under temporary names and renamed when whole."""
import uuid


def open_store(uri: str):
    """File system and path of a folder: a plain path, file://, hdfs://, s3://, gs://."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


class CommittedFile:
    """A stream to ``folder/name``. The file appears under its name only when ``commit`` is called; a lost or repeated task
    leaves at most a temporary file, and a second attempt replaces the first by the same bytes."""

    def __init__(self, store, folder: str, name: str):
        self.store, self.final = store, f"{folder}/{name}"
        self.temporary = f"{folder}/_temporary-{uuid.uuid4().hex}-{name}"
        self.stream, self.size = store.open_output_stream(self.temporary, compression=None), 0

    def write(self, data) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> str:
        self.stream.close()
        self.store.move(self.temporary, self.final)
        return self.final
