"""The signatures of known file formats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

# Name | extension | header (?? any byte) | footer | size rule | check | max size | min size | further settings.
TABLE = """
JPEG Image (JFIF) | jpg | FF D8 FF E0 | - | jpeg | jpeg_jfif | 104857600 | 4096 | -
JPEG Image (Exif) | jpg | FF D8 FF E1 | - | jpeg | jpeg_exif | 104857600 | 4096 | -
JPEG Image (Raw/DQT) | jpg | FF D8 FF DB | - | jpeg | jpeg_dqt | 104857600 | 4096 | -
PNG Image | png | 89 50 4E 47 0D 0A 1A 0A | 49 45 4E 44 AE 42 60 82 | png | png | 209715200 | 0 | -
PDF Document | pdf | 25 50 44 46 | 25 25 45 4F 46 | pdf | pdf | 104857600 | 0 | footer_last=true
ZIP / Office (DOCX/XLSX/PPTX) | zip | 50 4B 03 04 | 50 4B 05 06 | - | zip | 104857600 | 512 | footer_extra=18
GIF Image | gif | 47 49 46 38 | 00 3B | gif | gif | 10485760 | 4096 | -
BMP Image | bmp | 42 4D ?? ?? ?? ?? 00 00 00 00 | - | linear(@2,len=4,le,+0) | bmp | 314572800 | 0 | -
MP3 Audio | mp3 | 49 44 33 ?? 00 | - | - | mp3 | 52428800 | 4096 | -
MP4 Video | mp4 | ?? ?? ?? ?? 66 74 79 70 | - | mp4 | mp4 | 4294967296 | 4096 | -
RAR Archive | rar | 52 61 72 21 1A 07 | - | rar | rar | 524288000 | 0 | -
7-Zip Archive | 7z | 37 7A BC AF 27 1C | - | seven_zip | seven_zip | 524288000 | 0 | -
SQLite Database | db | 53 51 4C 69 74 65 20 66 6F 72 6D 61 74 20 33 00 | - | sqlite | sqlite | 10737418240 | 0 | -
WAV Audio (RIFF) | wav | 52 49 46 46 ?? ?? ?? ?? 57 41 56 45 | - | linear(@4,len=4,le,+8) | wav | 209715200 | 0 | -
AVI Video (RIFF) | avi | 52 49 46 46 ?? ?? ?? ?? 41 56 49 20 | - | linear(@4,len=4,le,+8) | avi | 209715200 | 0 | -
Matroska / MKV Video | mkv | 1A 45 DF A3 | - | ebml | mkv | 8589934592 | 0 | -
FLAC Audio | flac | 66 4C 61 43 | - | - | flac | 209715200 | 0 | -
Windows PE Executable | exe | 4D 5A 90 00 | - | pe | exe | 104857600 | 4096 | -
VMDK Disk Image | vmdk | 4B 44 4D 56 | - | - | vmdk | 524288000 | 65536 | -
OGG Media | ogg | 4F 67 67 53 | - | ogg_stream | ogg | 2147483648 | 0 | -
Windows Event Log | evtx | 45 4C 46 49 4C 45 00 | - | linear_scaled(@42,len=2,le,x65536,+4096) | evtx | 104857600 | 0 | -
Outlook PST/OST | pst | 21 42 44 4E | - | - | pst | 524288000 | 65536 | -
XML Document | xml | 3C 3F 78 6D 6C | - | text_bound | xml | 524288 | 256 | min_hit_gap=4194304
HTML Document | html | 3C 21 44 4F 43 54 59 50 45 | 3C 2F 68 74 6D 6C 3E | - | html | 10485760 | 0 | -
RTF Document | rtf | 7B 5C 72 74 66 31 | - | - | rtf | 52428800 | 0 | -
vCard Contact | vcf | 42 45 47 49 4E 3A 56 43 41 52 44 | 45 4E 44 3A 56 43 41 52 44 | - | vcard | 1048576 | 0 | -
iCalendar | ics | 42 45 47 49 4E 3A 56 43 41 4C 45 4E 44 41 52 | 45 4E 44 3A 56 43 41 4C 45 4E 44 41 52 | - | ical | 10485760 | 0 | -
OLE2 Compound (DOC/XLS/PPT) | ole | D0 CF 11 E0 A1 B1 1A E1 | - | ole2 | ole2 | 2147483648 | 0 | -
Sony ARW Raw Photo | arw | 49 49 2A 00 08 00 00 00 | - | tiff | arw | 200000000 | 1000000 | -
Canon CR2 Raw Photo | cr2 | 49 49 2A 00 ?? ?? ?? ?? 43 52 02 00 | - | tiff | cr2 | 120000000 | 1000000 | -
Panasonic RW2 Raw Photo | rw2 | 49 49 55 00 | - | tiff | rw2 | 150000000 | 1000000 | -
Fujifilm RAF Raw Photo | raf | 46 55 4A 49 46 49 4C 4D 43 43 44 2D 52 41 57 | - | raf | raf | 300000000 | 1000000 | -
TIFF Image (Little-Endian) | tif | 49 49 2A 00 | - | tiff | tiff_le | 1073741824 | 4096 | -
TIFF Image (Big-Endian) | tif | 4D 4D 00 2A | - | tiff | tiff_be | 1073741824 | 4096 | -
Nikon NEF Raw Photo | nef | 49 49 2A 00 | - | tiff | nef | 200000000 | 1000000 | -
Apple HEIC Photo (heic) | heic | ?? ?? ?? ?? 66 74 79 70 68 65 69 63 | - | mp4 | heic | 209715200 | 16384 | -
Apple HEIC Photo (heix) | heic | ?? ?? ?? ?? 66 74 79 70 68 65 69 78 | - | mp4 | heic | 209715200 | 16384 | -
QuickTime MOV Video | mov | ?? ?? ?? ?? 66 74 79 70 71 74 20 20 | - | mp4 | mov | 4294967296 | 4096 | -
iTunes M4V Video | m4v | ?? ?? ?? ?? 66 74 79 70 4D 34 56 20 | - | mp4 | m4v | 4294967296 | 4096 | -
3GPP / 3GPP2 Mobile Video | 3gp | ?? ?? ?? ?? 66 74 79 70 33 67 | - | mp4 | 3gp | 536870912 | 4096 | -
WebM Video | webm | 1A 45 DF A3 | - | ebml | webm | 8589934592 | 0 | -
Windows Media Video / ASF | wmv | 30 26 B2 75 8E 66 CF 11 A6 D9 00 AA 00 62 CE 6C | - | asf | wmv | 524288000 | 4096 | -
Flash Video (FLV) | flv | 46 4C 56 01 | - | - | flv | 52428800 | 4096 | min_hit_gap=1048576
MPEG-2 / MPEG-1 Program Stream | mpg | 00 00 01 BA | - | mpeg_ps | mpeg | 4294967296 | 4096 | min_hit_gap=16777216
WebP Image | webp | 52 49 46 46 ?? ?? ?? ?? 57 45 42 50 | - | linear(@4,len=4,le,+8) | webp | 104857600 | 0 | -
AAC / M4A Audio | m4a | ?? ?? ?? ?? 66 74 79 70 4D 34 41 20 | - | mp4 | m4a | 524288000 | 4096 | -
GZip Compressed | gz | 1F 8B | - | - | gz | 536870912 | 20 | -
Email Message (EML) | eml | 46 72 6F 6D 20 | - | - | eml | 10485760 | 64 | min_hit_gap=4194304
ELF Executable / Shared Library | elf | 7F 45 4C 46 | - | elf | elf | 104857600 | 64 | -
Windows Registry Hive (REGF) | dat | 72 65 67 66 | - | linear(@40,len=4,le,+0) | regf | 524288000 | 4096 | -
Adobe Photoshop Document (PSD/PSB) | psd | 38 42 50 53 | - | - | psd | 209715200 | 512 | -
VHD Virtual Hard Disk | vhd | 63 6F 6E 65 63 74 69 78 | - | - | vhd | 524288000 | 512 | -
VHDX Virtual Hard Disk | vhdx | 76 68 64 78 66 69 6C 65 | - | - | vhdx | 524288000 | 1048576 | -
QCOW2 Virtual Disk (QEMU) | qcow2 | 51 46 49 FB | - | - | qcow2 | 524288000 | 65536 | -
MIDI Audio | mid | 4D 54 68 64 | - | midi | midi | 10485760 | 32 | -
AIFF Audio | aif | 46 4F 52 4D ?? ?? ?? ?? 41 49 46 ?? | - | linear(@4,len=4,be,+8) | aiff | 209715200 | 0 | -
XZ Compressed | xz | FD 37 7A 58 5A 00 | - | - | xz | 209715200 | 32 | -
BZip2 Compressed | bz2 | 42 5A 68 ?? | - | - | bzip2 | 209715200 | 14 | -
RealMedia / RealVideo | rm | 2E 52 4D 46 | - | - | realmedia | 524288000 | 18 | -
Windows Icon (ICO) | ico | 00 00 01 00 | - | - | ico | 1048576 | 22 | min_hit_gap=524288
Olympus ORF Raw Photo | orf | 49 49 52 4F | - | tiff | orf | 150000000 | 1000000 | -
Pentax PEF Raw Photo | pef | 49 49 2A 00 | - | tiff | pef | 157286400 | 1000000 | -
Mach-O 64-bit Executable | macho | CF FA ED FE | - | - | macho | 104857600 | 64 | -
Canon CR3 Raw Photo | cr3 | ?? ?? ?? ?? 66 74 79 70 63 72 78 20 | - | mp4 | cr3 | 200000000 | 1000000 | -
Sony SR2 Raw Photo | sr2 | 49 49 2A 00 08 00 00 00 | - | tiff | sr2 | 104857600 | 1000000 | -
EPUB e-Book | epub | 50 4B 03 04 | 50 4B 05 06 | - | epub | 104857600 | 1024 | -
OpenDocument (ODT/ODS/ODP) | odt | 50 4B 03 04 | 50 4B 05 06 | - | odt | 104857600 | 1024 | -
Outlook Message (MSG) | msg | D0 CF 11 E0 A1 B1 1A E1 | - | ole2 | msg | 104857600 | 0 | -
WavPack Audio | wv | 77 76 70 6B | - | - | wavpack | 209715200 | 32 | -
CorelDRAW Drawing | cdr | 52 49 46 46 ?? ?? ?? ?? 43 44 52 ?? | - | linear(@4,len=4,le,+8) | cdr | 104857600 | 512 | -
Shockwave Flash (FWS — uncompressed) | swf | 46 57 53 | - | linear(@4,len=4,le,+0) | swf | 104857600 | 8 | -
Shockwave Flash (CWS — zlib) | swf | 43 57 53 | - | - | swf | 31457280 | 8 | -
Shockwave Flash (ZWS — LZMA) | swf | 5A 57 53 | - | - | swf | 31457280 | 8 | -
Kodak DCR Raw Photo | dcr | 49 49 2A 00 | - | tiff | dcr | 30000000 | 1000000 | -
Canon CRW Raw Photo | crw | 49 49 1A 00 00 00 48 45 41 50 43 43 44 52 | - | - | crw | 30000000 | 100000 | -
Minolta MRW Raw Photo | mrw | 00 4D 52 4D | - | - | mrw | 30000000 | 100000 | -
KeePass 2.x Database (KDBX) | kdbx | 03 D9 A2 9A 67 FB 4B B5 | - | - | kdbx | 10485760 | 256 | -
KeePass 1.x Database (KDB) | kdb | 03 D9 A2 9A 65 FB 4B B5 | - | - | kdb | 10485760 | 256 | -
EnCase Evidence File (E01) | e01 | 45 56 46 09 0D 0A FF 00 | - | - | e01 | 524288000 | 1048576 | -
PCAP Network Capture (little-endian) | pcap | D4 C3 B2 A1 | - | - | pcap | 209715200 | 24 | -
PCAP Network Capture (big-endian) | pcap | A1 B2 C3 D4 | - | - | pcap | 209715200 | 24 | -
Windows Minidump | dmp | 4D 44 4D 50 93 A7 | - | - | dmp | 67108864 | 1024 | -
Apple Binary Property List (bplist) | plist | 62 70 6C 69 73 74 30 30 | - | - | plist | 10485760 | 34 | -
MPEG Transport Stream (TS) | ts | 47 | - | mpeg_ts(off=0,stride=188) | ts | 2147483648 | 18800 | min_hit_gap=536870912, suppress_group=mpeg_transport
Blu-ray M2TS Video | m2ts | ?? ?? ?? ?? 47 | - | mpeg_ts(off=4,stride=192) | m2ts | 2147483648 | 19200 | min_hit_gap=536870912, suppress_group=mpeg_transport
LUKS Encrypted Disk Image | luks | 4C 55 4B 53 BA BE | - | - | luks | 524288000 | 4096 | -
Sigma X3F Raw Photo | x3f | 46 4F 56 62 | - | - | x3f | 157286400 | 100000 | -
Monkey's Audio (APE) | ape | 4D 41 43 20 | - | - | ape | 209715200 | 512 | -
Sun AU Audio | au | 2E 73 6E 64 | - | au | au | 524288000 | 24 | -
TrueType Font (TTF) | ttf | 00 01 00 00 00 | - | ttf | ttf | 52428800 | 4096 | min_hit_gap=524288
WOFF Web Font | woff | 77 4F 46 46 | - | linear(@8,len=4,be,+0) | woff | 10485760 | 44 | -
Microsoft Compiled HTML Help (CHM) | chm | 49 54 53 46 03 00 00 00 60 00 00 00 | - | - | chm | 52428800 | 96 | -
Blender 3D File | blend | 42 4C 45 4E 44 45 52 | - | - | blend | 209715200 | 12 | -
Adobe InDesign Document | indd | 06 06 ED F5 D8 1D 46 E5 BD 31 EF E7 FE 74 B7 1D | - | - | indd | 209715200 | 16 | -
Windows WTV Television Recording | wtv | B7 D8 00 20 37 49 DA 11 A6 4E 00 07 E9 5E AD 8D | - | - | wtv | 524288000 | 16 | -
ISO 9660 Disc Image | iso | 43 44 30 30 31 | - | iso9660 | iso | 9395240960 | 32769 | header_offset=32769
DICOM Medical Image | dcm | 44 49 43 4D | - | - | dicom | 524288000 | 256 | header_offset=128
TAR Archive (POSIX ustar) | tar | 75 73 74 61 72 00 | - | tar | tar | 2147483648 | 512 | header_offset=257
PHP Script | php | 3C 3F 70 68 70 | - | - | php | 10485760 | 6 | -
Shell / Script File (Shebang) | sh | 23 21 | - | - | shebang | 1048576 | 16 | min_hit_gap=1048576
JPEG Image (COM) | jpg | FF D8 FF FE | FF D9 | - | jpeg_com | 104857600 | 4096 | -
Java Class File | class | CA FE BA BE | - | - | java_class | 52428800 | 32 | -
Microsoft Cabinet | cab | 4D 53 43 46 | - | linear(@8,len=4,le,+0) | cab | 536870912 | 32 | -
OpenType Font (OTF) | otf | 4F 54 54 4F | - | - | otf | 52428800 | 256 | -
WOFF2 Web Font | woff2 | 77 4F 46 32 | - | linear(@8,len=4,be,+0) | woff2 | 52428800 | 48 | -
Android Dalvik Executable | dex | 64 65 78 0A | - | linear(@32,len=4,le,+0) | dex | 104857600 | 112 | -
Adobe Photoshop Large Document (PSB) | psb | 38 42 50 53 00 02 | - | - | psd | 209715200 | 26 | -
Raw AAC Audio (MPEG-4 ADTS) | aac | FF F1 | - | adts | aac | 52428800 | 128 | min_hit_gap=4096
Raw AAC Audio (MPEG-2 ADTS) | aac | FF F9 | - | adts | aac | 52428800 | 128 | min_hit_gap=4096
DjVu Document | djvu | 41 54 26 54 46 4F 52 4D | - | linear(@8,len=4,be,+12) | djvu | 52428800 | 20 | -
OpenEXR High Dynamic Range Image | exr | 76 2F 31 01 | - | - | exr | 209715200 | 256 | -
GIMP XCF Image | xcf | 67 69 6D 70 20 78 63 66 20 76 | - | - | xcf | 104857600 | 20 | -
JPEG 2000 Image | jp2 | 00 00 00 0C 6A 50 20 20 0D 0A 87 0A | - | - | - | 52428800 | 32 | -
PCX Image | pcx | 0A | - | - | pcx | 1048576 | 128 | -
BPG Image | bpg | 42 50 47 FB | - | - | - | 5242880 | 16 | -
Java Archive (JAR) | jar | 50 4B 03 04 | - | - | jar | 104857600 | 38 | -
Python Bytecode 3.6 (.pyc) | pyc | 33 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
Python Bytecode 3.7 (.pyc) | pyc | 42 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
Python Bytecode 3.8 (.pyc) | pyc | 55 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
Python Bytecode 3.9 (.pyc) | pyc | 61 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
Python Bytecode 3.10 (.pyc) | pyc | 6F 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
Python Bytecode 3.11 (.pyc) | pyc | A7 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
Python Bytecode 3.12 (.pyc) | pyc | CB 0D 0D 0A | - | - | pyc | 1048576 | 16 | -
LZH / LHA Archive | lzh | 2D 6C 68 ?? 2D | - | - | lzh | 209715200 | 22 | header_offset=2
HDF5 Scientific Data File | h5 | 89 48 44 46 0D 0A 1A 0A | - | - | hdf5 | 524288000 | 64 | -
FITS Astronomy Image | fits | 53 49 4D 50 4C 45 20 20 3D | - | - | fits | 524288000 | 2880 | -
Apache Parquet | parquet | 50 41 52 31 | - | - | - | 524288000 | 20 | -
DPX Film Image (Big-Endian) | dpx | 53 44 50 58 | - | - | dpx | 209715200 | 2048 | -
DPX Film Image (Little-Endian) | dpx | 58 50 44 53 | - | - | dpx | 209715200 | 2048 | -
VirtualBox VDI Disk Image | vdi | 7F 10 DA BE | - | - | vdi | 524288000 | 512 | header_offset=64
AFF Forensic Disk Image | aff | 41 46 46 00 00 00 01 | - | - | - | 524288000 | 64 | -
Windows Shell Link (LNK) | lnk | 4C 00 00 00 01 14 02 00 00 00 00 00 C0 00 00 00 00 00 00 46 | - | - | lnk | 1048576 | 76 | -
Windows Prefetch (XP / Server 2003) | pf | 11 00 00 00 | - | - | prefetch | 10485760 | 500 | -
Windows Prefetch (Vista / 7) | pf | 17 00 00 00 | - | - | prefetch | 10485760 | 500 | -
Windows Prefetch (8 / 8.1) | pf | 1A 00 00 00 | - | - | prefetch | 10485760 | 500 | -
Windows Prefetch (10 / 11) | pf | 1E 00 00 00 | - | - | prefetch | 10485760 | 500 | -
Windows Event Log (EVT) | evt | 30 00 00 00 4C 66 4C 65 | - | - | evt | 20971520 | 48 | -
PEM Certificate / Key | pem | 2D 2D 2D 2D 2D 42 45 47 49 4E | - | - | pem | 1048576 | 64 | -
Bitcoin Wallet (Berkeley DB) | wallet | 62 31 05 00 09 00 | - | - | - | 104857600 | 4096 | -
Parchive PAR2 Recovery Set | par2 | 50 41 52 32 00 50 4B 54 | - | - | par2 | 104857600 | 64 | -
"""


@dataclass(frozen=True)
class Signature:
    """One format; ``header`` has None where any byte fits."""

    name: str
    extension: str
    header: tuple[int | None, ...]
    footer: bytes
    size_rule: str
    check: str
    max_size: int
    min_size: int
    header_offset: int = 0
    min_hit_gap: int = 0
    suppress_group: str = ""
    footer_last: bool = False
    footer_extra: int = 0
    ordinal: int = field(default=0, compare=False)

    def positions(self, data: bytes, report: int) -> Iterator[int]:
        """Places in the first ``report`` bytes where the header fits, overlapping ones too.

        The longest run of fixed bytes is searched for, the others are compared; none for a header without a fixed byte.
        """
        return header_positions(self.header, data, report)


def _anchor(header: tuple[int | None, ...]) -> tuple[int, bytes]:
    """Longest run of fixed bytes and where it begins."""
    best, run = (0, b""), bytearray()
    for k, b in enumerate([*header, None]):
        if b is not None:
            run.append(b)
            continue
        if len(run) > len(best[1]):
            best = (k - len(run), bytes(run))
        run = bytearray()
    return best


def header_positions(header: tuple[int | None, ...], data: bytes, report: int) -> Iterator[int]:
    at, literal = _anchor(header)
    if not literal:
        return
    others = [(k, b) for k, b in enumerate(header) if b is not None and not at <= k < at + len(literal)]
    last = min(report, len(data) - len(header) + 1)
    found = data.find(literal, at)
    while found >= 0 and found - at < last:
        start = found - at
        if all(data[start + k] == b for k, b in others):
            yield start
        found = data.find(literal, found + 1)


def parse_hex(text: str) -> tuple[int | None, ...]:
    """Bytes of a header like ``FF ?? D8``."""
    return tuple(None if x == "??" else int(x, 16) for x in text.split())


def parse(table: str) -> list[Signature]:
    out = []
    for k, line in enumerate(table.strip().splitlines()):
        name, ext, header, footer, size, check, most, least, more = (c.strip() for c in line.split(" | "))
        settings = dict(x.strip().split("=") for x in more.split(",")) if more != "-" else {}
        out.append(
            Signature(
                name, ext.lstrip("."), parse_hex(header), bytes(b or 0 for b in parse_hex(footer)) if footer != "-" else b"", size if size != "-" else "", check if check != "-" else "",
                int(most), int(least), int(settings.get("header_offset", 0)), int(settings.get("min_hit_gap", 0)), settings.get("suppress_group", ""),
                settings.get("footer_last") == "true", int(settings.get("footer_extra", 0)), k,
            )
        )
    return out


def user_signature(name: str, extension: str, header: str, footer: str, max_size: int) -> Signature:
    """A signature of one's own: no size rule and no check; an empty header or no maximum size is refused."""
    if not header.split() or max_size <= 0 or not name.strip():
        raise ValueError("a signature needs a name, a header and a maximum size")
    return Signature(name.strip(), extension.lstrip("."), parse_hex(header), bytes(b or 0 for b in parse_hex(footer)), "", "", max_size, 0, ordinal=1 << 20)


SIGNATURES = parse(TABLE)
